"""Near-duplicate documents by MinHash.

Every document becomes the set of its distinct word shingles. Many universal hash functions each keep the minimum over
the set; bands of consecutive minima put similar sets into common buckets; the share of equal minima rejects most
chance meetings; the full sets decide. Links are closed into groups by large-star / small-star.

Exact copies share one node, so a group of any number of copies costs one row. In a bucket, each set is first compared
with one centre, that of its sets which meets most others anywhere: in a family of edited copies that is the text they come from, and nearly
all that is like anything is like it. Those links are closed, and a bucket whose sets then lie in one group is done. The sets of the others are
joined on their rarest shingles: of two similar sets, the first common shingle in an order by frequency stands near the front of both,
near enough to leave room for the overlap that the threshold asks for. A set that differs from its kin in more than the threshold
allows has rarer shingles of its own there and meets nobody, so the join stays small where a bucket's pairs would be
many, and misses no link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire.llm import wordhash
from quietwire.llm.components import connected_components
from quietwire.llm.scratch import release, stage

#: Share below the threshold, in equal minima, at which a pair is rejected unread: about five standard deviations.
MARGIN = 0.18


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each multiply-add-shift hash function over a set of 64-bit shingle hashes, as 32-bit numbers."""
    a, b = family
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(least, (shingles[i : i + 256, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int, n_hashes: int, seed: int = 7) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, minima) of every row; node identifies the shingle set and is null for the empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family(n_hashes, seed)
        for batch in batches:
            sizes, nodes, minimal = [], [], []
            for _, words, _ in wordhash.documents(batch.column(1), lower=True):
                shingles = wordhash.shingle_set(words, shingle)
                sizes.append(len(shingles))
                nodes.append(wordhash.digest(shingles) if len(shingles) else None)
                minimal.append(minima(shingles, family).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(minimal, pa.binary())], ["doc_id", "text_hash", "n_shingles", "node", "minima"])

    ids = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return ids.mapInArrow(sketch, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, node binary, minima binary")


def _values(column: pa.Array, dtype: type) -> Iterator[np.ndarray]:
    """The values of a binary column as arrays, without copies."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    for start, end in itertools.pairwise(offsets):
        yield np.frombuffer(data, dtype, count=(end - start) // np.dtype(dtype).itemsize, offset=start) if end > start else np.empty(0, dtype)


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, doc_id, shingles) of the wanted (node, doc_id, text_hash), read again from the texts."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sets = [], []
            asked = batch.column(1).to_pylist()
            for i, words, _ in wordhash.documents(batch.column(0), lower=True):
                shingles = wordhash.shingle_set(words, shingle)
                if len(shingles) and wordhash.digest(shingles) == asked[i]:  # texts of one id may share a hash
                    found.append(i)
                    sets.append(shingles.tobytes())
            rows = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), pa.array(sets, pa.binary())], ["node", "doc_id", "shingles"])

    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text")).alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_hash") == F.col("w.text_hash"))
    found = texts.join(wanted.alias("w"), same).select("t.text", "w.node", "w.doc_id")
    return found.mapInArrow(collect, f"node binary, doc_id {_type(wanted, 'doc_id')}, shingles binary").dropDuplicates(["node"])


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, first by their minima, then by their full sets, each as (no_id, doc_id, node).

    Arrow batches are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless set, so sets of long texts come a few at a time.
    """

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = [np.count_nonzero(x == y) / len(x) for x, y in zip(_values(batch.column(2), np.uint32), _values(batch.column(3), np.uint32), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.asarray(equal, dtype=float) >= percent / 100 - MARGIN))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = []
            for x, y in zip(_values(batch.column(2), np.uint64), _values(batch.column(3), np.uint64), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                verdicts.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(verdicts, pa.bool_()))

    def with_both(pairs: DataFrame, table: DataFrame, value: str, name: Column) -> DataFrame:
        left = table.select(F.col("node").alias("a"), F.col(value).alias("of_a"), name.alias("name_a"))
        right = table.select(F.col("node").alias("b"), F.col(value).alias("of_b"), name.alias("name_b"))
        return pairs.join(left, "a").join(right, "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "of_a", "of_b")

    likely = with_both(pairs, nodes, "minima", F.col("node")).mapInArrow(promising, "a binary, b binary")
    vertex = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")  # the least of a group has its least id
    named = f"struct<no_id:boolean,doc_id:{_type(nodes, 'doc_id')},node:binary>"
    return with_both(likely, sets, "shingles", vertex).mapInArrow(similar, f"a {named}, b {named}")


def _rare_shingle_pairs(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of different groups of (node, n, grp) that can be similar, by prefix and position filters."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sizes = np.asarray(part.column(1))
                index = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                values = np.concatenate(list(_values(part.column(3), np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(index) for k in range(3)), pa.array(values)], ["node", "n", "grp", "shingle"])

    rows = crowd.join(sets, "node").select("node", "n", "grp", "shingles").mapInArrow(spread, "node binary, n long, grp binary, shingle long")
    shared = stage(rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"))
    # shingles of one set alone come first in the order; they are counted, not ranked
    common = rows.join(shared, "shingle").withColumns({"rank": F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")), "own": F.col("n") - F.count("*").over(Window.partitionBy("node"))})
    # these are staged, so that they are worked out once and adaptive execution can split a shingle that very many sets have
    prefix = stage(common.withColumn("at", F.col("own") + F.col("rank")).filter(F.col("at") * 100 <= F.col("n") * (100 - percent) + 100).drop("df", "own", "rank"))
    # a shingle's largest group is only compared with the others, never with itself
    largest = stage(prefix.groupBy("shingle", "grp").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("grp", F.struct("k", "grp")).alias("main"), F.count("*").alias("groups")).filter("groups > 1"))
    x, y = prefix.join(largest, "shingle").filter("grp <> main").alias("x"), prefix.join(largest.select("shingle"), "shingle").alias("y")
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1
    enough = (rest * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.grp") != F.col("y.grp")) & enough)
    pairs = stage(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    release(shared, prefix, largest)
    return pairs


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, with_group: bool = False) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links), kept. With 30
    bands of 5 minima, a pair at exactly 0.8 meets in no bucket with a probability of 7e-6.

    Null or wordless texts have the empty set, link with nothing and are kept. A document with fewer words than a
    shingle has its whole sequence as its one shingle. Rows that repeat an id are each judged by their own text. A null id never names a group
    that holds another id, so such a row is kept only if nothing else is like it. With ``with_group``, the row's text_hash
    and a name of its group that differs between unlike groups of one id (null for the empty set) follow. Extra columns are ignored; an empty
    table gives no rows.
    """
    sketch = stage(signatures(df, id_col, text_col, shingle, bands * rows))
    filled = sketch.filter("node is not null")
    nodes = filled.groupBy("node").agg(F.first("minima").alias("minima"), F.first("n_shingles").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least"))
    nodes = stage(nodes.select("node", "minima", "n", "least.doc_id", "least.text_hash"))

    width = 4 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring(F.col("minima"), k * width + 1, F.lit(width))))
    banded = nodes.select("node", "n", F.explode(keys).alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    met = stage(banded.join(buckets, "band"))
    scored = met.join(met.groupBy("node").agg(F.sum("members").alias("meets")), "node")
    centres = scored.groupBy("band").agg(F.max_by("node", F.struct("meets", "node")).alias("centre"))
    stars = stage(met.join(centres, "band").filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())

    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash")
    sets = stage(_sets(df, wanted, id_col, text_col, shingle))

    first = stage(_verified(stars, nodes, sets, percent))
    groups = connected_components(first).select(F.col("node.node").alias("node"), F.col("component.node").alias("grp"))

    labelled = met.join(groups, "node", "left").select("band", "node", "n", F.coalesce("grp", "node").alias("grp"))
    mixed = labelled.groupBy("band").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low <> high")
    apart = stage(labelled.join(mixed.select("band"), "band").select("node", "n", "grp").distinct())
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _verified(_rare_shingle_pairs(apart, sets, percent).join(tried, ["a", "b"], "left_anti"), nodes, sets, percent)
    groups = connected_components(first.unionByName(second)).select(F.col("node.node").alias("node"), F.col("component.doc_id").alias("least"), F.col("component.node").alias("group"))
    release(met, stars, sets, first, apart)

    by_node = nodes.select("node", "doc_id").join(groups, "node", "left").select("node", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("group", "node").alias("group"))
    named = sketch.join(by_node, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *(["text_hash", "group"] if with_group else []))
