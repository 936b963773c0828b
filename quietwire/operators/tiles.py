"""Pairs of rows with equal keys, worked out tile by tile in tasks of bounded size.

The rows of a key are dealt into blocks by a hash of their ids, as many as its bytes and rows need; every pair of blocks is a tile, one
Spark group. Keys whose rows fit into a corner of a tile share one. So no task holds more than a tile, a heavy key is
spread over as many tasks as it has tiles, and what leaves a task is what the given function returns, not the pairs. A group has a price of
its own, whatever it holds, so small keys fill a tile by their pairs and bytes: their rows make far fewer pairs than those of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.config import DEFAULT, Settings
from quietwire.sources.staging import stage

#: Rows and bytes of one side of a tile, at most about so many: blocks are dealt by a hash.
TILE_ROWS, TILE_BYTES = 1024, 16 << 20
#: Small keys share tiles up to this part of one, which may have so many times its rows.
SHARED, SHARED_ROWS = 4, 8


def _blocks(rows: Column, size: Column, tile_rows: int, tile_bytes: int) -> Column:
    return F.ceil(F.greatest(F.lit(1.0), rows / tile_rows, size / tile_bytes)).cast("int")


def tiled(left: DataFrame, right: DataFrame, key: str, ids: tuple[str, str], sizes: tuple[Column, Column], function: Callable[[pa.Table, pa.Table], pa.Table], schema: str, tile_rows: int = TILE_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``function(left rows, right rows)`` for every tile of the rows of both tables with equal, non-null ``key``.

    A tile may hold several keys; every pair of rows with one key is in exactly one tile. ``ids`` deal a key's rows into blocks, ``sizes`` are
    the rows' bytes. Keys that only one table has are left out.
    """
    counted = [df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"_rows{side}"), F.sum(size).alias(f"_bytes{side}")) for side, (df, size) in enumerate(zip((left, right), sizes, strict=True))]
    known = counted[0].join(counted[1], key)
    blocks = [_blocks(F.col(f"_rows{side}"), F.col(f"_bytes{side}"), tile_rows, tile_bytes).alias(f"_blocks{side}") for side in (0, 1)]
    # a key's share of a tile: by its pairs, and by the fuller side
    pairs = F.col("_rows0") / tile_rows * F.col("_rows1") / tile_rows
    share = F.greatest(pairs, *[F.col(f"_rows{side}") / (SHARED_ROWS * tile_rows) for side in (0, 1)], *[F.col(f"_bytes{side}") / tile_bytes for side in (0, 1)])
    dealing = stage(known.select(key, *blocks, share.alias("_share")))
    small = F.col("_share") <= 1 / (2 * SHARED)
    packs = F.ceil(SHARED * F.coalesce(dealing.filter(small).agg(F.sum("_share").alias("s")).scalar(), F.lit(0.0))).cast("int")
    pack = F.when(small, F.concat(F.lit("shared "), F.pmod(F.xxhash64(key), F.greatest(packs, F.lit(1))).cast("string"))).otherwise(F.concat(F.lit("own "), F.col(key).cast("string")))
    dealing = dealing.select(key, "_blocks0", "_blocks1", pack.alias("_pack"))

    def dealt(df: DataFrame, side: int) -> DataFrame:
        own = F.pmod(F.xxhash64(ids[side]), F.col(f"_blocks{side}")).cast("int").alias(f"_block{side}")
        others = F.explode(F.sequence(F.lit(0), F.col(f"_blocks{1 - side}") - 1)).alias(f"_block{1 - side}")
        fresh = [F.col(c).alias(c) for c in df.columns]  # both sides may come from one table
        return df.join(dealing, key).select(*fresh, F.col("_pack").alias(f"_pack{side}"), own, others)

    groups = [dealt(df, side).groupBy(f"_pack{side}", "_block0", "_block1") for side, df in enumerate((left, right))]
    return groups[0].cogroup(groups[1]).applyInArrow(function, schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _codes(left: pa.ChunkedArray | pa.Array, right: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of two columns, equal for equal ones; a null is a value of its own."""
    both = pa.concat_arrays([x if isinstance(x, pa.Array) else _whole(x) for x in (left, right)])
    codes = both.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(left)], codes[len(left) :]


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Place of each text in code-point order, nulls last."""
    ranks = np.empty(len(column), dtype=np.int64)
    ranks[pc.sort_indices(column).to_numpy(zero_copy_only=False)] = np.arange(len(column))
    return ranks


class KeyPairs:
    """All pairs (i, j) of left and right rows with one key, as flat arrays; those of a left row stand together."""

    def __init__(self, left: pa.ChunkedArray, right: pa.ChunkedArray):
        own, other = _codes(left, right)
        self.right_order = np.argsort(other, kind="stable")
        #: Where the right rows of each left row's key begin in that order, and how many they are.
        self.begin = np.searchsorted(other[self.right_order], own, side="left")
        self.count = np.searchsorted(other[self.right_order], own, side="right") - self.begin
        #: Where the pairs of each left row begin.
        self.offset = np.concatenate([[0], np.cumsum(self.count)])
        self.i = np.repeat(np.arange(len(own)), self.count)
        self.j = self.right_order[np.arange(self.offset[-1]) - np.repeat(self.offset[:-1] - self.begin, self.count)]
        self.place = np.empty(len(other), dtype=np.int64)
        self.place[self.right_order] = np.arange(len(other))

    def __len__(self) -> int:
        return len(self.i)

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Index of the pairs (i, j), which must have one key."""
        return self.offset[i] + self.place[j] - self.begin[i]


def vectors_of(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows, their vectors), of rows with a vector without null, infinite or undefined components."""
    column = _whole(column)
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.empty(0, np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    found = {}
    for length in np.unique(lengths[valid]).tolist():
        rows = np.flatnonzero(valid & (lengths == length))
        if length:
            values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)
            fine = np.isfinite(values).all(axis=1)
            if fine.any():
                found[length] = rows[fine], values[fine]
    return found


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all rows of x with all of y; 0 where a vector is zero."""
    norms = np.sqrt(np.multiply.outer((x * x).sum(axis=1), (y * y).sum(axis=1)))
    return np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=norms != 0)


def pair_cosines(pairs: KeyPairs, left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    """The cosine of each pair; undefined (nan) where a vector is missing or the two have unlike lengths."""
    out = np.full(len(pairs), np.nan)
    mine, theirs = vectors_of(left), vectors_of(right)
    for length in mine.keys() & theirs.keys():
        rows, x = mine[length]
        others, y = theirs[length]
        order = np.argsort(pairs.place[others], kind="stable")
        others, y = others[order], y[order]
        places = pairs.place[others]
        group, firsts = np.unique(pairs.begin[rows], return_inverse=True)
        by_key = np.argsort(firsts, kind="stable")
        bounds = np.searchsorted(firsts[by_key], np.arange(len(group) + 1))
        for g in range(len(group)):  # one product for each key
            at = by_key[bounds[g] : bounds[g + 1]]
            at = at[pairs.count[rows[at]] > 0]
            if not len(at):
                continue
            low, high = np.searchsorted(places, [group[g], group[g] + pairs.count[rows[at[0]]]])
            if low < high:
                out[pairs.at(rows[at][:, None], others[None, low:high])] = cosines(x[at], y[low:high])
    return out


def _weights(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    """(row, token, weights) of a column of arrays of (token, w), or of (token, w0, w1, ...) with a weight, or none, for each reading."""
    cells = _whole(column)
    items = cells.flatten()
    rows = pc.list_parent_indices(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    names = [field.name for field in items.type if field.name != "token"]
    return rows, items.field("token"), [items.field(name).to_numpy(zero_copy_only=False).astype(np.float64) for name in names]


#: Common tokens of pairs that one step adds up.
STEP = 1 << 20


def pair_lexical(pairs: KeyPairs, left: pa.ChunkedArray, right: pa.ChunkedArray, reading: np.ndarray | None = None) -> np.ndarray:
    """Weight of the tokens that each pair shares, by the root of the product of both rows' weights; 0 without any.

    Where the right rows have a weight for each reading, ``reading`` tells which one each left row meets.
    """
    i, own, (w,) = _weights(left)
    j, other, each = _weights(right)
    shared = np.zeros(len(pairs))
    if not len(i) or not len(j):
        return shared
    reading = np.zeros(len(pairs.count), dtype=np.int64) if reading is None else reading
    own, other = _codes(own, other)
    # a token is another one in each reading
    told = [np.flatnonzero(~np.isnan(v)) for v in each]
    sums = np.bincount(i, w, minlength=len(pairs.count)), np.stack([np.bincount(j[at], v[at], minlength=len(pairs.place)) for at, v in zip(told, each, strict=True)])
    own = own * len(each) + reading[i]
    other = np.concatenate([other[at] * len(each) + r for r, at in enumerate(told)])
    j = np.concatenate([j[at] for at in told])
    # a token of a left row meets the rows of its key that have it too: runs of the right rows in order of token and key
    width = len(pairs.place) + 1
    theirs = other * width + pairs.place[j]
    order = np.argsort(theirs, kind="stable")
    theirs = theirs[order]
    mine = own * width + pairs.begin[i]
    low, high = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine + pairs.count[i])
    met = high - low
    ends = np.cumsum(met)
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, side="right")))
        n = met[a:b]
        which = np.repeat(np.arange(a, b), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
        np.add.at(shared, pairs.at(i[which], j[order[place]]), w[which])
        a = b
    norms = np.sqrt(sums[0][pairs.i] * sums[1][reading[pairs.i], pairs.j])
    return np.divide(shared, norms, out=np.zeros(len(pairs)), where=(norms > 0) & (shared > 0))


def rounded(x: np.ndarray, digits: int = 4) -> np.ndarray:
    """Numbers in units of the last of some digits, rounded half away from zero on their shortest decimal form."""
    scaled = np.abs(x) * 10**digits
    whole = np.floor(scaled + 0.5)
    flat, values = whole.reshape(-1), x.reshape(-1)
    for at in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        flat[at] = int((abs(Decimal(repr(float(values[at])))) * 10**digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(whole, x).astype(np.int64)


def first_of(pairs: KeyPairs, at: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Of the pairs ``at``, the k of each left row with the highest score, the lowest ``tie`` among equals."""
    if not len(at):
        return at
    i, points, ties = pairs.i[at], score[at], tie[at]
    spans = [int(x.max()) - int(x.min()) + 1 for x in (i, points, ties)]
    if spans[0] * spans[1] * spans[2] < 1 << 62:  # one number to sort by instead of three
        order = np.argsort(((i - i.min()) * spans[1] + (points.max() - points)) * spans[2] + (ties - ties.min()), kind="stable")
    else:
        order = np.lexsort((ties, -points, i))
    rows = i[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(rows)]])))
    return at[order[rank < k]]


CANDIDATES = "message_id string, hist_id string, hist_seq long, structural double, semantic double, outcome string"
#: What the two sides of a tile have in common.
PAIRED = ("conversation_type", "group_id", "business_id", "sender_user_id", "media_type", "forwarded_count")


def structural(pairs: KeyPairs, left: pa.Table, right: pa.Table, parts: tuple[tuple[str, float], ...], forwarded: float) -> np.ndarray:
    """E03 of every pair: the weights of what is equal and not empty, added in order, at most 1."""
    total = np.zeros(len(pairs))
    for name, weight in parts:
        own, other = _codes(left[name], right[name])
        told = np.array([x is not None and (x != "" or name == "conversation_type") for x in left[name].to_pylist()], dtype=bool)
        total += np.where((own[pairs.i] == other[pairs.j]) & told[pairs.i], weight, 0.0)
    often = [np.array([x is not None and x >= 3 for x in side["forwarded_count"].to_pylist()], dtype=bool) for side in (left, right)]
    return np.minimum(1.0, total + np.where(often[0][pairs.i] & often[1][pairs.j], forwarded, 0.0))


def top_candidates(parts: tuple[tuple[str, float], ...], forwarded: float, support: dict[str, dict[str, float]], want: int, settings: Settings = DEFAULT, near: float | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A tile's pairs that can be among the most similar of their message (W01), or among its evidence whatever is sought.

    A message's first k pairs over all tiles are among its first k of their own tile, so what is left out is in no result; a tile
    returns ``similar_k`` pairs and ``want`` for each intent at most for each of its messages. With ``near``, of the ``similar_k`` those are left out whose score is lower, but for the first.
    """
    e = settings.evidence

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = KeyPairs(left["pair_key"], right["pair_key"])
        alike = structural(pairs, left, right, parts, forwarded)
        close = pair_cosines(pairs, left["vector"], right["vector"])
        close = np.where(np.isnan(close), pair_lexical(pairs, left["tokens"], right["tokens"], np.array(left["reading"].to_pylist(), dtype=np.int64)), close)
        own, other = _codes(left["plain_id"], right["hist_id"])
        apart = np.flatnonzero(own[pairs.i] != other[pairs.j])
        seq = np.array(right["hist_seq"].to_pylist(), dtype=np.int64)[pairs.j]
        score = rounded(0.65 * np.maximum(0.0, close) + 0.35 * alike)
        kept = [first_of(pairs, apart, score, seq, e.similar_k)]
        if near is not None:
            kept = [kept[0][score[kept[0]] >= round(near * 10000) - 1], first_of(pairs, apart, score, seq, 1)]
        bounded = np.minimum(1.0, np.maximum(0.0, close))
        fitting = apart[~((alike[apart] < e.min_structural) & (bounded[apart] < e.min_semantic))]
        names, outcomes = _ranks(right["hist_id"])[pairs.j], right["outcome"].to_pylist()
        for by_outcome in support.values():
            behaviour = np.array([by_outcome[x] for x in outcomes], dtype=np.float64)[pairs.j]
            total = rounded(e.semantic * bounded + e.structural * alike + e.behavioural * behaviour)
            kept.append(first_of(pairs, fitting[total[fitting] >= round(e.min_total * 10000)], total, names, want))
        at = np.unique(np.concatenate(kept))
        i, j = pa.array(pairs.i[at]), pa.array(pairs.j[at])
        columns = [left["message_id"].take(i), right["hist_id"].take(j), right["hist_seq"].take(j), pa.array(alike[at], pa.float64()), pa.array(close[at], pa.float64()), right["outcome"].take(j)]
        return pa.table(columns, names=["message_id", "hist_id", "hist_seq", "structural", "semantic", "outcome"])

    return chosen


def partners(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each left row (message_id, user_id, tokens) of a tile, how many right rows of its user share a token with it."""
    pairs = KeyPairs(left["user_id"], right["user_id"])
    n = np.bincount(pairs.i[pair_lexical(pairs, left["tokens"], right["tokens"]) > 0], minlength=len(left))
    rows = np.flatnonzero(n)
    return pa.table([left["message_id"].take(pa.array(rows)), pa.array(n[rows], pa.int64())], names=["message_id", "partners"])


def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each left row (id, key, vector) of a tile, how many other right rows of its key there are, and its highest cosine with one."""
    pairs = KeyPairs(left["key"], right["key"])
    close = pair_cosines(pairs, left["vector"], right["vector"])
    close[np.array(left["id"].to_pylist())[pairs.i] == np.array(right["id"].to_pylist())[pairs.j]] = np.nan
    told = np.flatnonzero(~np.isnan(close))
    rows, starts, n = np.unique(pairs.i[told], return_index=True, return_counts=True)
    best = np.maximum.reduceat(close[told], starts) if len(rows) else np.empty(0)
    return pa.table([left["id"].take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(best, pa.float64())], names=["id", "partners", "nearest"])


#: Cosines that one step holds.
COSINES = 1 << 20


def best_intents(exemplars: dict[int, list[tuple[str, list[float]]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """C23 of batches of (message_id, vector): the intent of the best exemplar, the later in order among equals, if it is sure, and its lead.

    ``exemplars`` are (intent, vector) by length, in order of intents.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, (rows, x) in vectors_of(pa.chunked_array([batch.column(1)])).items():
                if length not in exemplars:
                    continue
                names = [intent for intent, _ in exemplars[length]]
                starts = [i for i, intent in enumerate(names) if i == 0 or intent != names[i - 1]]
                y = np.array([v for _, v in exemplars[length]], dtype=np.float64)
                step = max(1, COSINES // len(y))
                for a in range(0, len(rows), step):
                    best = np.maximum.reduceat(rounded(cosines(x[a : a + step], y), 3), starts, axis=1)
                    last = best.shape[1] - 1 - best[:, ::-1].argmax(axis=1)
                    at = np.arange(len(best))
                    first = best[at, last].copy()
                    best[at, last] = np.iinfo(np.int64).min
                    second = best.max(axis=1) if best.shape[1] > 1 else np.zeros(len(best), dtype=np.int64)
                    gap = first / 1000 - second / 1000
                    sure = (gap >= 0.12) & (first >= 350)
                    intents = [names[starts[k]] if s else "" for k, s in zip(last.tolist(), sure.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[a : a + step])), pa.array(intents, pa.string()), pa.array(rounded(gap, 3) / 1000, pa.float64())], ["message_id", "intent", "margin"])

    return told


def vector_bytes(vector: Column) -> Column:
    return 8 * F.greatest(F.coalesce(F.size(vector), F.lit(0)), F.lit(0)) + 64


def nearest_by_key(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, partners, nearest) for the rows of ``asked`` that others of ``rows`` share a key with; both are (id, key, vector).

    No vector is sent once a pair: a block of vectors goes to the tiles of its key, a tile returns a row for each vector asked for.
    """
    size = vector_bytes(F.col("vector"))
    told = tiled(asked, rows, "key", ("id", "id"), (size, size), nearest, f"id {dict(asked.dtypes)['id']}, partners long, nearest double")
    return told.groupBy("id").agg(F.sum("partners").alias("partners"), F.max("nearest").alias("nearest"))

