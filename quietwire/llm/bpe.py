"""Byte-level BPE over a given rank file.

A text is split by the tokenizer's pattern; each piece that is no token itself is merged on its own. A segment tree over
the piece's byte positions holds, at each live token, the rank of the pair it forms with the next live one, and in each
inner node the leftmost minimum below it. A merge updates three leaves: the merged token, the absorbed one and the live
neighbour before them. A piece of n bytes takes O(n log n) steps, also when a text has no space at all.

Ids are kept packed, four bytes each in little-endian order, as training shards hold them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Vocabularies are broadcast, so their size is checked.
MAX_VOCABULARY = 1_000_000
#: Texts and pieces that a Python worker remembers.
CACHED = 150_000
#: Rows go through Python in runs of about so many bytes, whole rows each.
RUN_BYTES = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens are more than {MAX_VOCABULARY}")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    n = len(piece)
    if piece in ranks or n < 2:
        return [ranks[piece]] if n else []
    never = n * (MAX_VOCABULARY + 1)
    size = 1 << (n - 1).bit_length()
    # a leaf is rank * n + position, so that the least value is the leftmost pair of the least rank
    tree = [never] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for i in range(size - 1, 0, -1):
        x, y = tree[2 * i], tree[2 * i + 1]
        tree[i] = x if x < y else y
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        while at > 1:
            x, y = tree[at], tree[at ^ 1]
            at >>= 1
            least = x if x < y else y
            if tree[at] == least:
                return
            tree[at] = least

    def pair(at: int) -> int:
        following = ends[at]
        rank = get(piece[at : ends[following]]) if following < n else None
        return never if rank is None else rank * n + at

    while tree[1] < never:
        at = tree[1] % n
        absorbed = ends[at]
        ends[at] = ends[absorbed]
        if ends[at] < n:
            before[ends[at]] = at
        put(absorbed, never)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return ids


class Vocabulary:
    """Ranks, and every pair of tokens whose bytes together are a token, as sorted keys."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([x])] for x in range(256)], dtype=np.int64)
        pairs = {(ranks[token[:i]] << 32) | ranks[token[i:]]: rank for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[x] for x in self.keys.tolist()], dtype=np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray, never: int) -> np.ndarray:
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], never)


#: Longer pieces are merged one by one.
TOGETHER = 64
#: Pieces whose trees are held at once.
TREES = 2048


def merge_many(pieces: list[bytes], vocabulary: Vocabulary) -> dict[bytes, bytes]:
    """Packed ids of many short pieces: one segment tree each, all trees updated together."""
    found: dict[bytes, bytes] = {}
    by_size: dict[int, list[bytes]] = {}
    for piece in pieces:
        if len(piece) > TOGETHER:
            found[piece] = np.asarray(merge(piece, vocabulary.ranks), dtype="<u4").tobytes()
        else:
            by_size.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(piece)
    for size, group in by_size.items():
        for i in range(0, len(group), TREES):
            found.update(_merge_together(group[i : i + TREES], size, vocabulary))
    return found


def _merge_together(group: list[bytes], size: int, vocabulary: Vocabulary) -> Iterator[tuple[bytes, bytes]]:
    rows = len(group)
    lengths = np.array([len(x) for x in group])
    never = (MAX_VOCABULARY + 1) * size
    columns = np.arange(size)
    alive = columns < lengths[:, None]
    ids = vocabulary.of_byte[np.frombuffer(b"".join(x.ljust(size, b"\0") for x in group), np.uint8)].reshape(rows, size)
    ends = np.tile(columns + 1, (rows, 1))
    before = np.tile(columns - 1, (rows, 1))
    tree = np.full((rows, 2 * size), never, dtype=np.int64)
    tree[:, size:-1] = np.where(alive[:, 1:], np.minimum(vocabulary.pair_ranks(ids[:, :-1], ids[:, 1:], MAX_VOCABULARY + 1) * size + columns[:-1], never), never)
    for level in [1 << x for x in range(size.bit_length() - 2, -1, -1)]:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def leaves(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What stands at a live token's leaf: the rank of its pair with the next one."""
        following = ends[row, at]
        inside = following < lengths[row]
        rank = vocabulary.pair_ranks(ids[row, at], ids[row, np.minimum(following, size - 1)], MAX_VOCABULARY + 1)
        return np.where(inside, np.minimum(rank * size + at, never), never)

    def lift(row: np.ndarray, at: np.ndarray) -> None:
        node = at + size
        while node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    while len(row := np.flatnonzero(tree[:, 1] < never)):
        least = tree[row, 1]
        at = least % size
        absorbed = ends[row, at]
        following = ends[row, absorbed]
        ids[row, at] = least // size
        alive[row, absorbed] = False
        ends[row, at] = following
        inner = following < lengths[row]
        before[row[inner], following[inner]] = at[inner]
        tree[row, size + absorbed] = never
        tree[row, size + at] = leaves(row, at)
        left = before[row, at]
        has = left >= 0
        tree[row[has], size + left[has]] = leaves(row[has], left[has])
        lift(row, absorbed)
        lift(row, at)
        if has.any():
            lift(row[has], left[has])
    packed = ids[alive].astype("<u4").tobytes()
    stops = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
    return zip(group, [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True)


#: A space between two characters that are no white space starts a piece whatever surrounds them, so that texts can be cut
#: there, and what stands between two cuts has the same ids wherever it stands.
_CUT = re.compile(r" (?=\S)(?<=\S )")
#: White space, with which no other run can start; taken off before anything is encoded.
_FIRST = "\n"


class Encoder:
    """Encodes batches of texts. Remembers the packed ids of the first ``CACHED`` short runs and pieces it meets."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        self.split = regex.compile(pattern).findall
        self.vocabulary = Vocabulary(ranks)
        #: By run as it follows a space; the run at the start of a text, which follows none, has _FIRST before it.
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = [_CUT.split(_FIRST + text) if text else [] for text in texts]
        split = self.split
        new = {run: split(run[1:] if run[0] == _FIRST else " " + run) for run in set().union(*cut).difference(self.runs)}
        added = self._add_pieces(set().union(*new.values()).difference(self.pieces))
        piece = self.pieces.__getitem__
        runs = self.runs
        runs.update([(run, b"".join(map(piece, pieces))) for run, pieces in new.items()])
        packed = [b"".join(map(runs.__getitem__, each)) for each in cut]
        _forget(runs, new)
        _forget(self.pieces, added)
        return packed

    def _add_pieces(self, pieces: set[str]) -> list[str]:
        ranks, merging = self.vocabulary.ranks, {}
        for piece in pieces:
            raw = piece.encode()
            if raw in ranks:
                self.pieces[piece] = ranks[raw].to_bytes(4, "little")
            else:
                merging[piece] = raw
        merged = merge_many(list(merging.values()), self.vocabulary)
        self.pieces.update([(piece, merged[raw]) for piece, raw in merging.items()])
        return list(pieces)


def _forget(cache: dict[str, bytes], added: Iterable[str]) -> None:
    """Take out of what was added all long texts, and so many others that ``CACHED`` are left."""
    spare = len(cache) - CACHED
    for text in added:
        if spare > 0 or len(text) > TOGETHER:
            del cache[text]
            spare -= 1


_workers: dict[tuple[str, str], Encoder] = {}


def _encoder(key: tuple[str, str], ranks: dict[bytes, int]) -> Encoder:
    if key not in _workers:
        _workers[key] = Encoder(key[1], ranks)
    return _workers[key]


def _runs(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + RUN_BYTES, side="right")))
        yield batch.slice(i, j - i)
        i = j


def _with_column(df: DataFrame, source: str, target: str, keep_source: bool, convert: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    at = df.columns.index(source)
    kept = [i for i in range(len(df.columns)) if keep_source or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = convert()
        for batch in batches:
            for part in _runs(batch, at):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), each(part.column(at))], [*(part.schema.names[i] for i in kept), target])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(target, T.BinaryType())]))


def _is_new(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"{name} is a column already")


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """Add ``ids_col``: the packed token ids of each whole text, special tokens being ordinary text.

    ``pattern`` splits a text into pieces; as in all byte-level tokenizers' patterns, a single space goes to the piece that
    follows it. ``keep_text=False`` leaves the texts out of the result. Null and empty texts have no tokens (an empty value). Every row and every other column is passed on, repeated rows too; an empty table gives no rows.
    ``ids_col`` must be a new name.
    """
    _is_new(df, ids_col)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = ranks_path, pattern

    def convert() -> Callable[[pa.Array], pa.Array]:
        one = _encoder(key, ranks.value)
        return lambda texts: pa.array(one(texts.to_pylist()), pa.binary())

    return _with_column(df, text_col, ids_col, keep_text, convert)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Add ``bytes_col``: the bytes that packed ids stand for. Null ids give null; an id outside the vocabulary is an error. ``bytes_col`` must be a new name."""
    _is_new(df, bytes_col)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def convert() -> Callable[[pa.Array], pa.Array]:
        tokens = {rank: token for token, rank in ranks.value.items()}
        return lambda ids: pa.array([None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids.to_pylist()], pa.binary())

    return _with_column(df, ids_col, bytes_col, keep_ids, convert)
