"""Spelling variants: words one code point apart, by pairs of trie nodes.

Every distinct beginning of a word is a node of a forward trie, every distinct ending one of a reversed trie; both kinds are
numbered. A word of length k has a pair (node of its first i code points, node of the rest) for each of its k + 1 splits, and a pair
(node of its first i, node of what follows position i) for each of its k skipped positions. Words that share a pair of skips differ by one
replacement there; a word whose split has the pair of another's skip lacks that one code point. Both are exact, and
a pair has as many words as the alphabet has code points, and one more, so no group grows with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.llm.scratch import release, stage

#: A word is taken from a maximal run of these.
RUNS = r"[A-Za-z\u00C0-\u00FF]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Beginnings and endings are told apart as they are up to so many code points, longer ones by a 128-bit digest.
PLAIN = 64
#: Rows of a batch that a word's pairs are given out in.
ROWS = 50_000
#: Words whose pairs one task makes.
WORDS_A_TASK = 20_000
#: The nodes of up to SHALLOW code points, of which there are few, have many words each: their rows are dealt over so many tasks.
SHALLOW, DEALT = 2, 32


def runs_of(text: Column) -> Column:
    """The runs of a text, with only A-Z in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), lambda run: F.translate(run, _UPPER, _UPPER.lower()))


def damaged(doc_id: Column, run: Column, every: int) -> Column:
    """The run; where ``every`` divides the crc32 of ``<doc_id>:<run>``, without its code point at crc32 modulo its length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.greatest(F.char_length(run), F.lit(1))).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, every: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points that are found ``least_count`` times or more in all texts."""
    run = F.explode(runs_of(F.col(text_col).cast("string"))).alias("run")
    word = F.col("run") if every is None else damaged(F.col("id"), F.col("run"), every)
    words = df.select(F.col(id_col).alias("id"), run).select(word.alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keys(code_points: str) -> list[bytes]:
    """Keys of the beginnings of 0, 1, 2, ... code points: the beginning itself, or the digest of a long one, in linear time."""
    keys = [code_points[:i].encode() for i in range(min(len(code_points), PLAIN) + 1)]
    if len(code_points) > PLAIN:
        digest = hashlib.blake2b(code_points[:PLAIN].encode(), digest_size=16)
        for c in code_points[PLAIN:]:
            digest.update(c.encode())
            keys.append(b"\xff" + digest.digest())  # no text begins with this byte
    return keys


_SPLITS = pa.schema({"id": pa.int64(), "n": pa.int64(), "before": pa.binary(), "after": pa.binary(), "beyond": pa.binary(), "first": pa.bool_()})


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word and position: keys of what is before it, of what follows with and (``beyond``, null at the end) without the
    code point there, and whether that one is the first of its run of equals, so that each shorter word is reached once."""
    columns: list[list] = [[] for _ in _SPLITS]
    for batch in batches:
        for word_id, word, n in zip(*(batch[name].to_pylist() for name in ("id", "word", "n")), strict=True):
            before, after = _keys(word), _keys(word[::-1])[::-1]
            for i in range(0, len(before), ROWS):
                part = range(i, min(i + ROWS, len(before)))
                firsts = (k < len(word) and (k == 0 or word[k] != word[k - 1]) for k in part)
                for column, values in zip(columns, ([word_id] * len(part), [n] * len(part), before[i : i + ROWS], after[i : i + ROWS], [*after[i + 1 : i + ROWS + 1], None][: len(part)], firsts), strict=True):
                    column.extend(values)
                if len(columns[0]) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPLITS, strict=True)], schema=_SPLITS)
                    columns = [[] for _ in _SPLITS]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPLITS, strict=True)], schema=_SPLITS)


def _sorted(side: DataFrame) -> DataFrame:
    """``side`` of a join, to be sorted and merged: its rows are as many as words or nodes, but its size is judged by a staged file's compressed
    one, and before its rows are dealt, so that it would be broadcast through the driver."""
    return side.hint("merge")


def _shallow(key: Column) -> Column:
    return F.octet_length(key) <= SHALLOW


def _numbered(rows: DataFrame, key: str, nodes: DataFrame, ending: bool, name: str) -> DataFrame:
    """``rows`` with the number of the node of ``key`` instead of it."""
    there = nodes.filter(F.col("ending") == ending)
    dealt = F.when(_shallow(F.col("key")), F.sequence(F.lit(0), F.lit(DEALT - 1))).otherwise(F.array(F.lit(0)))
    there = there.select(F.col("key").alias("_key"), "node", F.explode(dealt).alias("_dealt"))
    own = F.when(_shallow(F.col(key)), F.pmod(F.col("id"), F.lit(DEALT)).cast("int")).otherwise(0)
    joined = rows.join(_sorted(there), (F.col(key) == F.col("_key")) & (own == F.col("_dealt")))
    return joined.drop(key, "_key", "_dealt").withColumnRenamed("node", name)


def _nodes(splits: DataFrame) -> DataFrame:
    """Number the nodes of both tries: (ending, key, node)."""
    both = F.inline(F.array(F.struct(F.lit(False).alias("ending"), F.col("before").alias("key")), F.struct(F.lit(True).alias("ending"), F.col("after").alias("key"))))
    return splits.select(both).distinct().withColumn("node", F.monotonically_increasing_id())


def _near(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best) from the members of all pairs; best is (-n, id) of the commonest near word, the first in order among equals."""
    member = F.struct("id", "n", "skip", "first")
    groups = pairs.groupBy("before", "after").agg(F.collect_list(member).alias("members")).filter(F.size("members") > 1)
    each = groups.select("members", F.explode("members").alias("x"))

    def near(y: Column) -> Column:
        x = F.col("x")
        return (y["id"] != x["id"]) & F.when(x["skip"] & y["skip"], F.lit(True)).when(x["skip"], x["first"]).otherwise(y["first"])

    others = each.select(F.col("x.id").alias("id"), F.transform(F.filter("members", near), lambda y: F.struct((-y["n"]).alias("less"), y["id"].alias("id"))).alias("others"))
    found = others.filter(F.size("others") > 0).select("id", F.size("others").alias("k"), F.array_min("others").alias("best"))
    return found.groupBy("id").agg(F.sum("k").cast("long").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) by doubling the steps taken along (id, form), which never come back: a form has at least twice its word's count."""
    at = stage(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("id").alias("_at"), F.col("root").alias("_next"))
        further = stage(at.join(_sorted(ahead), at["root"] == ahead["_at"], "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        release(at)
        at = further
        if not at.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]:
            return at.drop("moved")


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """Every word with its near words' number, its form and its root.

    ``words`` has word and n, a row for each word. Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's
    form is its near word of largest n, the smallest in code-point order among equals, if that n is at least ``factor`` (2 or more) times its own; its
    root is where following forms ends, the word itself without any. Returns word, form (or null), root, n, n_near, form_n (or null).

    Null words are left out, the empty word is near every word of one code point, and words of any length are compared whole. Other columns are ignored;
    no words give no rows. The tables staged for the result stay until their owner deletes them.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    # numbers in code-point order, so that ties between words are ties between numbers
    known = stage(words.filter("word is not null").select("word", "n").orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    tasks = known.count() // WORDS_A_TASK + 1
    splits = known.repartition(tasks, "id").mapInArrow(_splits, "id long, n long, before binary, after binary, beyond binary, first boolean")
    nodes = stage(_nodes(splits))
    begun = _numbered(splits, "before", nodes, False, "before")
    ways = F.array(F.struct(F.lit(False).alias("skip"), F.col("after").alias("rest")), F.struct(F.lit(True).alias("skip"), F.col("beyond").alias("rest")))
    pairs = begun.select("id", "n", "first", "before", F.inline(ways)).filter("rest is not null")
    near = stage(_near(_numbered(pairs, "rest", nodes, True, "after")))
    release(nodes)
    counted = known.join(_sorted(near), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best"))
    counted = counted.select("id", "word", "n", "n_near", F.col("best.id").alias("form_id"), (-F.col("best.less")).cast("long").alias("form_n"))
    roots = _roots(counted.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = lambda key, name: _sorted(known.select(F.col("id").alias(key), F.col("word").alias(name)))
    out = counted.join(_sorted(roots.select("id", F.col("root").alias("root_id"))), "id", "left").join(named("form_id", "form"), "form_id", "left").join(named("root_id", "root"), "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, every: int | None = None) -> DataFrame:
    """``group_variants`` of the words of all texts, by the word as it is after ``damaged`` (``every``; None: as it is written).

    Null texts have no words and a null id counts as an empty one; repeated rows count each time; texts and words of any length are read whole. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    return group_variants(count_words(df, id_col, text_col, least_length, least_count, every))
