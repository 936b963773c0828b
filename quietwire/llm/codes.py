"""Product codes of vectors: integer k-means on every part, with exact nearest entries by sliced bitmasks.

A part's codebook has at most 64 entries. For every dimension the entries' coordinates are sorted, and each place in that order carries the mask
of the entries before it. Around a vector, a radius selects a range of each dimension's order; the masks of a range's two ends
differ in the entries inside it, and the ranges' masks ANDed over all dimensions leave the entries in a box around the vector. The radius is the distance to
one entry, the nearest in the first dimension, so the box holds that entry and every one as near or nearer: the candidates are exact.

Sums by part and entry are all that leaves a task: rows bounded by parts times entries, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.llm.scratch import stage

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components become integers by this factor, and none may reach LARGEST then: squares are summed in 64 bits.
SCALE, LARGEST = 4096, 1 << 28
#: Bytes of integers that one step of a task holds.
STEP_BYTES = 1 << 23


class Codebook:
    """The entries of one part: ``entries`` is an integer array, a row each."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a codebook has at most 64 entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        #: masks[d][k]: the entries in the first k places of dimension d.
        self.masks = np.zeros((entries.shape[1], len(entries) + 1), dtype=np.uint64)
        for d in range(entries.shape[1]):
            np.bitwise_or.accumulate(np.uint64(1) << order[:, d].astype(np.uint64), out=self.masks[d, 1:])
        self.first = order[:, 0] if entries.shape[1] else np.zeros(len(entries), dtype=np.int64)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """A mask for each point: the entries within its distance to one entry in every dimension, the nearest of all among them."""
        if not points.shape[1]:
            return np.ones(len(points), dtype=np.uint64)
        place = np.searchsorted(self.sorted[:, 0], points[:, 0])
        below, above = np.maximum(place - 1, 0), np.minimum(place, len(self.entries) - 1)
        nearer = points[:, 0] - self.sorted[below, 0] <= self.sorted[above, 0] - points[:, 0]
        seed = self.entries[self.first[np.where(nearer, below, above)]]
        # one more than the root's floor, so that its rounding cannot leave out an entry
        radius = np.sqrt(((points - seed) ** 2).sum(axis=1).astype(np.float64)).astype(np.int64) + 1
        found = np.full(len(points), np.iinfo(np.uint64).max)
        for d, masks in enumerate(self.masks):
            low = np.searchsorted(self.sorted[:, d], points[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], points[:, d] + radius, side="right")
            found &= masks[high] ^ masks[low]
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, the lower index among equals."""
        found = self.candidates(points)
        index, least = np.zeros(len(points), dtype=np.int64), np.full(len(points), np.iinfo(np.int64).max)
        for i, entry in enumerate(self.entries):
            at = np.flatnonzero(found & np.uint64(1 << i))
            distance = ((points[at] - entry) ** 2).sum(axis=1)
            better = distance < least[at]
            index[at[better]], least[at[better]] = i, distance[better]
        return index, least


def _integers(column: pa.Array, length: int) -> Iterator[np.ndarray]:
    """The vectors of a batch as integers, some rows at a time; their length is made a multiple of PARTS with zeros."""
    wide = -(-length // PARTS) * PARTS
    step = max(1, STEP_BYTES // (8 * max(wide, 1)))
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        floats = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), length)
        values = np.floor(floats * SCALE)
        if values.size and np.abs(values).max() >= LARGEST:
            raise ValueError(f"a component of {LARGEST // SCALE} or more, or as far below 0, is too large to be coded")
        out = np.zeros((len(part), wide), dtype=np.int64)
        out[:, :length] = values
        yield out


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is given and has neither null nor infinite nor undefined components."""
    vector = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return df.filter(vector.isNotNull() & ~F.exists(vector, bad))


def _books(codebooks: np.ndarray) -> list[Codebook]:
    return [Codebook(entries) for entries in codebooks]


def _sums(codebooks: np.ndarray, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's count and component sums of every part and entry that it has vectors for."""
    parts, entries, width = codebooks.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(codebooks)
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            for vectors in _integers(batch.column(0), length):
                for p, book in enumerate(books):
                    points = vectors[:, p * width : (p + 1) * width]
                    index, _ = book.nearest(points)
                    counts[p] += np.bincount(index, minlength=entries)
                    np.add.at(sums[p], index, points)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(counts[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return summed


def train(df: DataFrame, codebooks: np.ndarray, length: int, rounds: int = ROUNDS, vector_col: str = "embedding") -> np.ndarray:
    """The codebooks (part, entry, position) after some rounds over all vectors, all of ``length`` components."""
    vectors = df.select(vector_col)
    for _ in range(rounds):
        partial = vectors.mapInArrow(_sums(codebooks, length), "part long, entry long, n long, sums array<long>")
        each = partial.select("part", "entry", "n", F.posexplode("sums").alias("position", "value"))
        # a row for every part, entry and position: the size of the codebooks
        totals = each.groupBy("part", "entry", "position").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("n").alias("n")).collect()
        codebooks = codebooks.copy()
        for row in totals:
            codebooks[row.part, row.entry, row.position] = int(row.value) // row.n
    return codebooks


def _coded(codebooks: np.ndarray, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = codebooks.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(codebooks)
        for batch in batches:
            codes, errors = [], []
            for vectors in _integers(batch.column(1), length):
                found = [book.nearest(vectors[:, p * width : (p + 1) * width]) for p, book in enumerate(books)]
                codes += [row.tobytes() for row in np.stack([index for index, _ in found], axis=1).astype(np.uint8)]
                errors.append(sum(distance for _, distance in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(np.concatenate(errors) if errors else [], pa.int64())], ["row", "code", "error"])

    return coded


def compress(df: DataFrame, keep: list[str], id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): ``row`` (a struct of the columns ``keep``), code (a byte a part) and error (squared distances summed) of every vector.

    A component x counts as the integer floor(4096 * x). The codebooks start as the parts of the 16 vectors of smallest id (equal ids by their
    vectors, null ids last) and are fitted in ``rounds`` rounds over all vectors: every part goes to its nearest entry, the lower index among
    equals, and an entry with parts becomes their componentwise floored mean. Rows without a vector, or with a null, infinite or undefined
    component, are left out, as are vectors of another length than the first one's; a length that is no multiple of 8 is filled up with
    zeros. Fewer than 16 vectors make as many entries, repeated rows count each time, an empty table gives no rows and empty codebooks. A component of 65,536 or
    more, or as far below zero, is an error. Other columns are left alone.
    """
    vectors = usable(df, id_col, vector_col)
    first = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).orderBy(F.asc_nulls_last("id"), "vector").limit(1).collect()
    length = len(first[0].vector) if first else 0
    same = vectors.filter(F.size(vector_col) == length)
    start = same.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).orderBy(F.asc_nulls_last("id"), "vector").limit(ENTRIES).collect()
    rows = list(_integers(pa.array([x.vector for x in start], pa.list_(pa.float64())), length))
    flat = np.concatenate(rows) if rows else np.zeros((0, 0), dtype=np.int64)
    codebooks = flat.reshape(len(flat), PARTS, -1).transpose(1, 0, 2) if len(flat) else np.zeros((PARTS, 0, 0), dtype=np.int64)
    if len(flat):
        codebooks = train(same, np.ascontiguousarray(codebooks), length, rounds, vector_col)
    given = same.select(F.struct(*keep).alias("row"), F.col(vector_col))
    schema = f"row {given.schema['row'].dataType.simpleString()}, code binary, error long"
    coded = given.mapInArrow(_coded(codebooks, length), schema) if len(flat) else given.select("row", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    return coded, codebooks


def with_group_error(coded: DataFrame, group_col: str) -> DataFrame:
    """Each row with ``group_error``, the errors summed over the rows of an equal ``row.group_col``, nulls together."""
    rows = stage(coded)
    group = F.col(f"row.{group_col}")
    totals = rows.groupBy(group.alias("_group")).agg(F.sum("error").alias("group_error"))
    return rows.join(totals, group.eqNullSafe(F.col("_group"))).drop("_group")
