"""Near-duplicate vectors by int8 tile products with proven error bounds.

Vectors of one label are dealt into blocks; every pair of blocks is a tile, one Spark group. In a tile each unit vector
u is held as s * q + e with q in int8. For two vectors, u.v differs from s_u s_v q_u.q_v by at most
|e_v| |s_u q_u| + |e_u| |s_v q_v| + |e_u| |e_v|, and the norms are known exactly, so only pairs whose product plus
that bound reaches the threshold are recomputed in double precision from the given vectors. No pair is missed, and no pair is
linked on the approximation alone.

A tile returns, for each of its vectors, the number of vectors linked in it, and a spanning forest of its links: at
most one row for each vector, however many links there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.llm.components import connected_components
from quietwire.llm.scratch import stage

#: Rows of a block; two blocks of 64 floats each take some MB.
BLOCK_ROWS = 4096
#: Rows of one product inside a tile.
STRIP_ROWS = 512
#: Above the rounding of the float arithmetic around the bounds.
SLACK = 1e-6


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, norm of scale * q, norm of the error) of rows scaled to unit length."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    held = q * scale[:, None]
    return q, scale, np.linalg.norm(held, axis=1), np.linalg.norm(unit - held, axis=1)


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine(x[i], y[j]) >= threshold, strip by strip."""
    qx, sx, nx, ex = quantise(x)
    qy, sy, ny, ey = quantise(y)
    # products of int8 rows stay below 2**24 in sum up to 1,040 dimensions: float32 holds them exactly, in double beyond that
    exact = np.float32 if x.shape[1] <= 1040 else np.float64
    qy = qy.astype(exact).T
    lx, ly = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for a in range(0, len(x), STRIP_ROWS):
        b = min(len(x), a + STRIP_ROWS)
        product = (qx[a:b].astype(exact) @ qy) * (sx[a:b, None] * sy)
        bound = nx[a:b, None] * ey + ex[a:b, None] * (ny + ey) + SLACK
        i, j = np.nonzero(product + bound >= threshold)
        i += a
        for c in range(0, len(i), 100_000):
            p, q = i[c : c + 100_000], j[c : c + 100_000]
            keep = np.einsum("nd,nd->n", x[p], y[q]) / (lx[p] * ly[q]) >= threshold
            if keep.any():
                yield p[keep], q[keep]


def _forest(links: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """Links that keep the n nodes as connected as all links do."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for p, q in links:
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            if (ra := root(a)) != (rb := root(b)):
                parent[max(ra, rb)] = min(ra, rb)
                kept.append((a, b))
    return kept


def _tile(threshold: float):
    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        vectors = np.asarray(group["embedding"].combine_chunks().flatten(), dtype=np.float64).reshape(group.num_rows, -1)
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])  # exact, and no norm overflows
        left = np.asarray(group["block"]) == np.asarray(group["tile_x"])
        weights, nodes = np.asarray(group["copies"]), group["node"]
        rows_x, rows_y = np.flatnonzero(left), np.flatnonzero(~left)
        same = not len(rows_y) and group["tile_x"][0].as_py() == group["tile_y"][0].as_py()
        counts = np.zeros(group.num_rows, dtype=np.int64)

        def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            other = rows_x if same else rows_y
            if not len(rows_x) or not len(other):
                return
            for i, j in linked_pairs(vectors[rows_x], vectors[other], threshold):
                p, q = rows_x[i], other[j]
                if same:
                    p, q = p[i < j], q[i < j]
                np.add.at(counts, p, weights[q])
                np.add.at(counts, q, weights[p])
                yield p, q

        forest = _forest(links(), group.num_rows)
        some = np.flatnonzero(counts)
        a, b = (pa.array([x[k] for x in forest], pa.int64()) for k in (0, 1))
        columns = {
            "a": pa.concat_arrays([nodes.take(pa.array(some)).combine_chunks(), nodes.take(a).combine_chunks()]),
            "b": pa.concat_arrays([pa.nulls(len(some), nodes.type), nodes.take(b).combine_chunks()]),
            "links": pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(forest), pa.int64())]),
        }
        return pa.table(columns)

    return link


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Link vectors of one label whose cosine is at least ``threshold``.

    Returns one row per input row: vec_id, n_links (other rows linked directly), component_id (the smallest id reachable
    by links), kept. Equal vectors of a label are one node with a number of copies, so groups of copies cost one row.

    A vector links with nothing if its label is null, or if it is null, empty, zero, or has a null or non-finite component;
    vectors of unequal length never link. Rows that repeat an id count as rows of their own in n_links. A row with a null
    id is kept only if it is linked with no other id. Extra columns are ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    node = F.when(usable, F.sha2(F.to_json(F.struct("label", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("v"))).cast("binary"), 256))
    rows = rows.withColumn("node", node)
    nodes = rows.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = stage(nodes.withColumn("length", F.size("embedding")))

    blocks = nodes.groupBy("label", "length").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = nodes.join(blocks, ["label", "length"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = dealt.select("label", "length", "node", "embedding", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("*", F.least("block", "other").alias("tile_x"), F.greatest("block", "other").alias("tile_y"))
    found = tiles.groupBy("label", "length", "tile_x", "tile_y").applyInArrow(_tile(threshold), "a string, b string, links long")
    found = stage(found)

    vertex = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "node")  # the least of a group has its least id
    ends = nodes.select("node", vertex.alias("vertex"))
    links = found.filter("b is not null").select("a", "b")
    links = links.join(ends.select(F.col("node").alias("a"), F.col("vertex").alias("x")), "a").join(ends.select(F.col("node").alias("b"), F.col("vertex").alias("y")), "b")
    groups = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).select("node.node", F.col("component.first_id").alias("least"), F.lit(True).alias("grouped"))
    counts = found.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.join(groups, "node", "left").join(counts, "node", "left").withColumn("component_id", F.when(F.col("grouped"), F.col("least")).otherwise(F.col("first_id")))
    by_node = named.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
