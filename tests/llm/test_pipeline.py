"""The stages on a small corpus with planted cases."""

import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from quietwire.llm import bpe


def test_planted_cases(spark, tmp_path):
    rng = random.Random(11)
    syllables = ["sun", "mo", "tree", "ri", "stone", "cloud", "fi", "la", "mer"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(120):
        docs.append((i, "\n".join(prose(40) for _ in range(3))))
        labels.append((i, 1, 0))
    for i in range(120, 150):
        docs.append((i, " ".join(rng.choice(["vile", "scum", "filth"]) if rng.random() < 0.2 else word() for _ in range(80))))
        labels.append((i, 1, 1))
    for i in range(150, 180):
        docs.append((i, " ".join(rng.choice(["$$$", "win***", "click!!"]) for _ in range(60))))
        labels.append((i, 0, 0))
    docs += [(200 + k, docs[k][1]) for k in range(10)]  # exact copies
    near = docs[20][1].split(" ")
    near[5] = "changed"
    docs += [(300, " ".join(near)), (301, None), (302, ""), (303, "short"), (304, docs[121][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(120)) <= set(rows)  # clean documents stay
    assert not set(rows) & {*range(120, 180), *range(200, 210), 300, 301, 302, 303, 304}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = dict(docs)
    for i, r in rows.items():
        assert r.n_tokens == len(library.encode_ordinary(texts[i]))
        assert r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]


def test_near_dedup_keeps_unlike_rows_of_one_id(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (4, text("c")), (5, text("d")), (5, text("e")), (5, text("e") + " more"), (6, text("d"))]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert left.columns == ["doc_id", "text"]
    got = [(r.doc_id, r.text[0]) for r in left.collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (None, "b"), (4, "c"), (5, "d"), (5, "e")], key=str)
