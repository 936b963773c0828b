"""MinHash, substring and vector dedup against brute force, with awkward rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from quietwire.llm import embeddings, minhash, substring, wordhash
from quietwire.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def make_texts(seed, n_base=12):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "ÉA", "naïve", "日本"]
    texts = []
    for _ in range(n_base):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "\t "]).join(copy).swapcase() if rng.random() < 0.3 else " ".join(copy))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [f"start {i} {passage} end {i}" for i in range(5)]
    texts += ["", None, "one two", "one  TWO", "one two three four", "   \n", "x" * 20_000 + " y"]
    rng.shuffle(texts)
    return texts


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(texts, k, percent):
    sets = {}
    for i, text in enumerate(texts):
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(parent, a), root(parent, b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(parent, i)) for i in sets}


@pytest.mark.parametrize(("seed", "k"), [(32, 4), (2, 5)])
def test_minhash_equals_brute_force(spark, seed, k):
    texts = make_texts(seed)
    rng = random.Random(seed)
    for _ in range(3):  # chains, of which no one text is like all others, and families at all distances from their origin
        words = [f"c{rng.randrange(10**6)}" for _ in range(150)]
        for n in range(40):
            if n < 20:
                words[n * 7 : n * 7 + 3] = [f"c{rng.randrange(10**6)}" for _ in range(3)]
                texts.append(" ".join(words))
            else:
                texts.append(" ".join(w if rng.random() > n / 800 else f"c{rng.randrange(10**6)}" for w in words))
    df = spark.createDataFrame([(i, x, "n", i) for i, x in enumerate(texts)], "doc_id long, text string, node string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=k).collect()}
    expected = brute_components(texts, k, 80)
    assert got == {i: (n, c, c == i) for i, (n, c) in expected.items()}


def test_minhash_rows_that_repeat_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    got = minhash.near_duplicates(spark.createDataFrame([(3, a), (5, a), (5, b), (8, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 5, True), (8, 5, False)]


def test_minhash_awkward_ids_and_empty_table(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (None, "only here is this"), (7, text + " b"), (9, None), (9, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(
        [("5", 26, "5", True), ("5", 26, "5", True), ("None", 26, "5", False), ("None", 1, "None", True), ("7", 27, "5", False), ("9", 0, "9", True), ("9", 0, "9", True)]
    )
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(500, 500), (7, 3), (7, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_windows(rows, window):
    own, words = {}, []
    for i, text in rows:
        w = WORD.findall(text or "")
        words.append(w)
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j : j + window])
                own[key] = min(own.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and own[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [50, 6])
def test_substring_equals_brute_force(spark, window):
    rows = list(enumerate(make_texts(3)))
    rows += [(None, rows[0][1]), (rows[2][0], rows[3][1]), (rows[4][0], rows[4][1])]
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], "doc_id long, text string, digest string")
    got = substring.remove_repeated_windows(df, window=window, with_text=True).collect()
    expected = brute_windows(rows, window)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(x[:4] for x in expected)
    texts = {(x[0], x[3]): x[4] for x in expected}
    assert all(r.kept_text == texts[str(r.doc_id), r.kept_sha256] for r in got if r.kept_text is not None)
    assert substring.remove_repeated_windows(df.limit(0)).count() == 0


def test_anchors_are_sliding_minima():
    words = np.random.default_rng(1).integers(0, 1 << 63, 200, dtype=np.uint64)
    grams = wordhash.sequence_hashes(words, substring.ANCHOR_WORDS)
    expected = [grams[i : i + 50 - substring.ANCHOR_WORDS + 1].min() for i in range(151)]
    assert substring.window_anchors(words, 50).tolist() == expected
    assert len(substring.window_anchors(words[:49], 50)) == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        base = rng.normal(size=(20, 16))
        for k in range(90):
            v = base[k % 20] * rng.uniform(0.5, 4) + rng.normal(size=16) * rng.choice([0, 0.02, 0.06, 0.15])
            rows.append((len(rows), v.astype(np.float32).tolist(), label))
    rows += [(len(rows), rows[0][1], 0), (len(rows) + 1, rows[0][1], 0), (900, [0.0] * 16, 0), (901, None, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] * 8, 0), (904, [], 0), (905, [1.0] * 3, 0), (906, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df, block_rows=16).collect()}
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    parent, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}
    for a in ok:
        for b in ok:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = root(parent, a[0]), root(parent, b[0])
                    parent[max(p, q)] = min(p, q)
    assert sum(links.values()) > 100
    assert got == {i: (links[i], root(parent, i), root(parent, i) == i) for i in parent}


def test_vectors_with_awkward_ids(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -2.0, 0.5]
    rows = [(4, a, 1), (4, a, 1), (9, b, 1), (None, a, 1), (None, b, 2), (2, a, 2), (7, [2.0, 4.0, 6.1], 1)]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, component string")
    got = embeddings.near_duplicate_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted(
        [("4", 3, "4", True), ("4", 3, "4", True), ("9", 0, "9", True), ("None", 3, "4", False), ("None", 0, "None", True), ("2", 0, "2", True), ("7", 3, "4", False)]
    )
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 33)) * 10.0 ** rng.integers(-3, 3, (60, 1)), rng.normal(size=(60, 33)) ** 3
    (qx, sx, nx, ex), (qy, sy, ny, ey) = embeddings.quantise(x), embeddings.quantise(y)
    true = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    error = np.abs(true - (qx.astype(float) @ qy.astype(float).T) * np.outer(sx, sy))
    assert (error <= nx[:, None] * ey + ex[:, None] * (ny + ey) + 1e-12).all()
