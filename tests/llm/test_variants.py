"""Toxicity, spelling variants and vector codes: brute force, held-out accuracy and awkward rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwire.llm import codes, queries, spelling, toxicity

SF = "/root/testdata/sf0.1"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# toxicity


def clean_and_toxic(n=240, seed=5):
    """Texts of invented words; a third of them has insults unknown to the given terms, all with one beginning, in varied surroundings."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abdeghilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(30, 80))]
        if i % 3 == 0:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), "zorkel" + rng.choice(["", "t", "ing", "ish", "ado"]) if rng.random() < 0.9 else "zorkelk")
        elif i % 10 == 1:
            words.insert(3, "zorkel")  # the word alone is no insult, only what is made of it
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_folding_and_exceptions():
    assert toxicity.fold("You 1D10T, m0r0n!! $tup\u0456d \uff49diot s\u200bcum") == " you idiot moron stupid idiot scum "
    assert toxicity.fold("IS!! it's 10 % 5kg|x") == " is it s skglx "
    assert toxicity.fold("") == toxicity.fold("12 ,.") == " "
    found = toxicity.Matcher(toxicity.Lexicon({" trash ": 5.0, " trash can ": 1.0, " zork": 2.0, " zorkel ": 3.0}, ("trash bag",), (0.0, 1.0)))
    assert found.matches(" trash ") == [(0, 7, 5.0)]
    assert found.matches(" a trash bag ") == [] and found.matches(" trash can ") == [(0, 7, 5.0)]
    assert found.matches(" zork zorke zorkel ") == [(5, 10, 2.0), (11, 19, 3.0)]  # a beginning is none on its own, the heaviest counts
    assert found.matches(" ") == [] and toxicity.Matcher(toxicity.Lexicon({}, (), (0.0, 1.0))).matches(" trash ") == []
    long = "so " * 200_000 + "trash "
    assert found.density(toxicity.fold(long))[0] == 1 and found.density(toxicity.fold(long))[2] < 0.01


def brute_matches(folded, terms, exceptions):
    words = folded.split()
    out = []
    spans = [(i, i + len(e.split())) for e in exceptions for i in range(len(words)) if words[i : i + len(e.split())] == e.split()]
    for i, word in enumerate(words):
        best = 0.0
        for term, weight in terms.items():
            parts = term.split()
            whole = term.endswith(" ")
            hit = words[i : i + len(parts)] == parts if whole else word.startswith(parts[0]) and word != parts[0]
            if hit and not any(a <= i and i + len(parts) <= b for a, b in spans):
                best = max(best, weight)
        if best:
            out.append(best)
    return out


def test_matches_equal_plain_search():
    rng = random.Random(3)
    terms = {" ab ": 2.0, " abc ": 1.0, " a b ": 4.0, " ab": 0.5, " ca": 3.0, " b ": 0.25}
    exceptions = ("ab c", "b b")
    matcher = toxicity.Matcher(toxicity.Lexicon(terms, exceptions, (0.0, 1.0)))
    for _ in range(500):
        folded = toxicity.fold(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 9))))
        assert [w for _, _, w in matcher.matches(folded)] == brute_matches(folded, terms, exceptions)


def test_learned_terms_tell_held_out_texts(spark):
    rows = clean_and_toxic()
    df = spark.createDataFrame([(i, x, "row") for i, x, _ in rows], "doc_id long, text string, row string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, labels)
    assert any(t.startswith(" zorkel") and not t.endswith(" ") for t in lexicon.terms)
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(df, lexicon, ["doc_id"]).select("row.doc_id", "score").collect()}
    held = [(i, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and all((scored[i] >= 0.7) == bool(t) for i, t in held)
    # labels of held-out rows are not read: turning them about changes nothing
    turned = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, _, t in rows], "doc_id long, toxic int")
    assert toxicity.learn(df, turned) == lexicon
    # a group of copies teaches nothing by its size
    copied = [(1000 + k, "the quovadi stands here") for k in range(200)]
    more = df.select("doc_id", "text").union(spark.createDataFrame(copied, "doc_id long, text string"))
    with_copies = labels.union(spark.createDataFrame([(i, 1) for i, _ in copied], "doc_id long, toxic int"))
    assert not any("quov" in t for t in toxicity.learn(more, with_copies).terms)


def test_toxicity_of_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "you idiot", 0.5), (4, "you idiot", 0.1), (4, "you idiot", 0.1), (5, "x " * 300_000, 0.1)], "doc_id long, text string, score double")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, empty)
    assert lexicon.scale == toxicity.GIVEN_SCALE
    rows = toxicity.score_toxicity(df, lexicon, ["doc_id", "score"]).select("row.doc_id", "n_words", "score").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_words, r.score))
    assert len(rows) == 6 and by[1] == by[2] and by[1][0][0] == 0 and by[4][0] == by[4][1] == by[None][0] and by[5][0][0] == 300_000
    assert by[1][0][1] < 0.1 < 0.7 < by[4][0][1]
    only_nulls = spark.createDataFrame([(None, None), (1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.learn(df, only_nulls) == lexicon and toxicity.learn(df.limit(0), empty) == lexicon
    assert toxicity.score_toxicity(df.limit(0), lexicon, ["doc_id"]).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_toxicity_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op11_toxicity(spark, SF).filter("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.9 * sum(r.toxic for r in rows) and sum(r.predicted and not r.toxic for r in rows) <= 0.002 * len(rows)


# spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, factor=2):
    found, form = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[v], v) for v in counts if v != w and near(w, v))
        found[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= factor * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, found[w], counts[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(8)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))): rng.choice([1, 2, 3, 4, 8, 8, 16, 40]) for _ in range(500)}
    counts |= {"aaaaaa": 2, "aaaaaaa": 4, "x" * 70: 3, "x" * 71: 9, "x" * 70 + "y": 1, "q" * 3000: 5, "q" * 1500 + "r" + "q" * 1500: 10, "q" * 2999: 1}
    words = spark.createDataFrame([(w, n, "s") for w, n in counts.items()] + [(None, 4, "s")], "word string, n long, id string")
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.group_variants(words).collect()}
    assert got == brute_variants(counts)
    assert spelling.group_variants(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(words, factor=1)


def test_variants_of_texts(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abceé") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(base).swapcase() if rng.random() < 0.2 else rng.choice(base) for _ in range(80)) + "-×÷_1" for _ in range(40)]
    rows = [*enumerate(texts), (40, None), (41, ""), (7, texts[7]), (None, texts[3]), (42, "w" * 60_000 + " " + "w" * 60_000 + " " + "w" * 60_000)]
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 7 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_variants(df, every=7).collect()}
    assert got == brute_variants(counts)
    assert spelling.spelling_variants(df.limit(0), every=7).count() == 0


# vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((i, [int(np.floor(4096 * x)) for x in v]) for i, v in rows)
    wide = -(-len(kept[0][1]) // parts) * parts
    vectors = [v + [0] * (wide - len(v)) for _, v in kept]
    w = wide // parts
    books = [[v[p * w : (p + 1) * w] for v in vectors[:entries]] for p in range(parts)]

    def best(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for v in vectors:
                members[best(p, v)[1]].append(v[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members, books[p], strict=True)]
    out = []
    for (i, _), v in zip(kept, vectors, strict=True):
        found = [best(p, v) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, [x for book in books for e in book for x in e]


@pytest.mark.parametrize(("n", "length"), [(150, 24), (9, 16), (60, 13), (20, 0)])
def test_codes_equal_brute_force(spark, n, length):
    rng = np.random.default_rng(n)
    vectors = np.round(rng.normal(size=(n, length)), 2)
    rows = [(i, v) for i, v in enumerate(vectors.tolist())] + [(n, [0.25] * length), (n + 1, [0.25] * length), (n + 1, [0.25] * length)]
    odd = [(-1, None), (-2, [float("nan")] + [0.0] * (length - 1)), (-3, [float("inf")] + [0.0] * (length - 1)), (-4, [None] + [0.0] * (length - 1))] if length else [(-1, None)]
    df = spark.createDataFrame([(i, v, "a" if i % 3 else None, 7) for i, v in rows + odd], "vec_id long, embedding array<double>, label string, error int")
    coded, codebooks = codes.compress(df, ["vec_id", "label", "error"])
    got = codes.with_group_error(coded, "label").select("row.vec_id", F.lower(F.hex("code")).alias("code"), "error", "row.label", "group_error").collect()
    expected, flat = brute_codes(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(expected)
    assert codebooks.reshape(-1).tolist() == flat
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.group_error == sums[r.label] for r in got)


def test_candidates_hold_the_nearest_and_little_else():
    rng = np.random.default_rng(1)
    book = codes.Codebook(rng.integers(-4000, 4000, size=(16, 8)))
    points = rng.integers(-5000, 5000, size=(3000, 8))
    distances = ((points[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
    index, least = book.nearest(points)
    assert (index == distances.argmin(axis=1)).all() and (least == distances.min(axis=1)).all()
    found = book.candidates(points)
    assert all(int(f) >> int(i) & 1 for f, i in zip(found, distances.argmin(axis=1), strict=True))
    assert np.mean([bin(int(f)).count("1") for f in found]) < 16
    same = codes.Codebook(np.array([[5, 5], [5, 5], [1, 1]]))
    assert same.nearest(np.array([[5, 5], [1, 2]]))[0].tolist() == [0, 2]


def test_codes_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, codebooks = codes.compress(spark.createDataFrame([], schema), ["vec_id", "label"])
    assert coded.count() == 0 and codebooks.size == 0
    nulls = spark.createDataFrame([(1, None, 2), (2, [float("nan")] * 8, None)], schema)
    assert codes.with_group_error(codes.compress(nulls, ["vec_id", "label"])[0], "label").count() == 0
    mixed = spark.createDataFrame([(None, [1.0] * 8, None), (3, [1.0] * 8, 1), (4, [1.0] * 9, 1)], schema)
    rows = codes.compress(mixed, ["vec_id", "label"])[0].select("row.vec_id", "error").collect()
    assert sorted((r.vec_id is None, r.error) for r in rows) == [(False, 0), (True, 0)]  # the vector of another length is left out
    with pytest.raises(Exception, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], schema), ["vec_id"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_code_query_has_one_digest(spark):
    rows = queries.op13_vector_codes(spark, "/root/testdata/sf0.001").collect()
    assert len({r.codebooks_sha256 for r in rows}) == 1 and len(rows[0].codebooks_sha256) == len(hashlib.sha256(b"").hexdigest())
