"""What grows with the data is dealt over tasks, whatever its size is taken for."""

import re

from quietwire.llm import spelling


def test_no_words_or_nodes_are_broadcast(spark, monkeypatch):
    plans, whole = [], spelling.stage

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df)

    monkeypatch.setattr(spelling, "stage", planned)
    words = spark.createDataFrame([("flour", 9), ("floar", 3), ("floor", 2), ("bread", 4), ("breads", 1)], "word string, n long")
    got = spelling.group_variants(words)
    roots = {r.word: r.root for r in got.collect()}
    assert roots == {"flour": "flour", "floar": "flour", "floor": "flour", "bread": "bread", "breads": "bread"}
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    kinds = [kind for plan in plans for kind in re.findall(r"\w*Join\b", plan)]
    assert kinds.count("SortMergeJoin") > 5 and not [x for x in kinds if "Broadcast" in x]
