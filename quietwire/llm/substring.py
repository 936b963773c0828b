"""Removal of word windows that already stand in a document with a smaller id.

A count-min sketch overestimates in how many documents a window stands, and a second pass groups only windows estimated to stand in two
or more, exactly. What is counted for a window is its anchor, the smallest hash of the k-grams inside it: equal windows have equal
anchors, so the count of an anchor is never below that of any of its windows, and neighbouring windows mostly share theirs, so a
document has about one anchor for twenty windows. Nothing repeated is lost: an estimate can only be too high.

The sketch has two rows of a bounded width, a few cells for each anchor of the corpus. Every task sketches the documents that it reads
and passes its sketch on in slices of SLICE_CELLS cells, as places and saturated counts; slices are merged where they meet, into one array each. No task
ever holds more than one slice of the whole.

Whole copies of a document are found by the digest of their word sequence first; every window of a copy starts in the
first of them, so copies are settled without windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.llm import wordhash
from quietwire.llm.scratch import release, stage

#: Words in the k-grams that serve as anchors.
ANCHOR_WORDS = 8
#: Cells in each of the sketch's two rows, for each anchor; the width is the power of two above that, of MIN_BITS bits at least.
CELLS_PER_ANCHOR = 4
MIN_BITS = 20
#: Cells of a slice, as a power of two: the array that one merge holds.
SLICE_BITS = 16
#: Anchors that a task sketches before it passes a sketch on.
SKETCHED = 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def window_anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window of a document."""
    grams = wordhash.sequence_hashes(words, min(ANCHOR_WORDS, window))
    span = window - min(ANCHOR_WORDS, window) + 1
    least, reach = grams, 1
    while reach < span:  # minima over runs twice as long each time
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        reach += step
    return least


def _cell(row: int, anchor: Column, bits: int) -> Column:
    """The cell of an anchor in a row of 2**bits cells."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(row), anchor), 64 - bits)


def _crowded_cells(documents: DataFrame, bits: int) -> DataFrame:
    """(row, cell) of the cells into which ``anchors`` of two or more documents fall."""
    in_slice = (1 << SLICE_BITS) - 1

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = ([], []), 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for row in (0, 1):
                cells, counts = np.unique(np.concatenate(held[row]), return_counts=True)
                slices, starts = np.unique(cells >> SLICE_BITS, return_index=True)
                places = np.split((cells & in_slice).astype("<u2"), starts[1:])
                counts = np.split(np.minimum(counts, 2).astype(np.uint8), starts[1:])
                columns = [pa.array([row] * len(slices), pa.int32()), pa.array(slices), pa.array([x.tobytes() for x in places], pa.binary()), pa.array([x.tobytes() for x in counts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "slice", "places", "counts"])

        for batch in batches:
            for row in (0, 1):
                held[row].append(batch.column(row).flatten().to_numpy())
            pending += len(held[0][-1])
            if pending >= SKETCHED:
                yield from passed_on()
                held, pending = ([], []), 0
        if pending:
            yield from passed_on()

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLICE_BITS, dtype=np.uint8)
        for part in parts:
            for places, counts in zip(part.column("places").to_pylist(), part.column("counts").to_pylist(), strict=True):
                places = np.frombuffer(places, "<u2")
                total[places] = np.minimum(total[places] + np.frombuffer(counts, np.uint8), 2)
        crowded = np.flatnonzero(total > 1) + (key[1].as_py() << SLICE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(crowded), pa.int32()), pa.array(crowded, pa.int64())], ["row", "cell"])

    cells = documents.select(F.transform("anchors", lambda x: _cell(0, x, bits)), F.transform("anchors", lambda x: _cell(1, x, bits)))
    return cells.mapInArrow(sketch, "row int, slice long, places binary, counts binary").groupBy("row", "slice").applyInArrow(merge, "row int, cell long")


def _suspects(documents: DataFrame, crowded: DataFrame, bits: int) -> DataFrame:
    """(doc_id, text_hash, anchors): of each document the anchors whose cells in both rows are crowded."""
    anchors = documents.select("doc_id", "text_hash", F.explode("anchors").alias("anchor"))
    for row in (0, 1):
        anchors = anchors.join(crowded.filter(F.col("row") == row).select("cell"), _cell(row, F.col("anchor"), bits) == F.col("cell"), "left_semi")
    return anchors.groupBy("doc_id", "text_hash").agg(F.collect_set("anchor").alias("anchors"))


def _scan(df: DataFrame, id_type: str, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, digest, anchors, kept_sha256 of the whole text) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, anchors, shas = [], [], [], []
            for _, words, raw in wordhash.documents(batch.column(1), lower=False):
                n.append(len(words))
                long_enough = len(words) >= window
                digests.append(wordhash.digest(words) if long_enough else None)
                anchors.append(np.unique(window_anchors(words, window)).view(np.int64) if long_enough else None)
                shas.append(hashlib.sha256(b" ".join(raw.tobytes().split())).hexdigest())
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(anchors, pa.list_(pa.int64())), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "digest", "anchors", "kept_sha256"])

    return df.mapInArrow(read, f"doc_id {id_type}, text_hash long, n_words long, digest binary, anchors array<long>, kept_sha256 string")


def _windows(df: DataFrame, id_type: str, window: int) -> DataFrame:
    """(high, low, doc_id, text_hash, position) of the windows of (doc_id, text, text_hash, anchors) with a listed anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(3)
            rows, high, low, place, pending = [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                index = pa.array(np.concatenate(rows))
                columns = [pa.array(np.concatenate(high).view(np.int64)), pa.array(np.concatenate(low)), batch.column(0).take(index), batch.column(2).take(index), pa.array(np.concatenate(place))]
                return pa.RecordBatch.from_arrays(columns, ["high", "low", "doc_id", "text_hash", "position"])

            for i, data, offsets in wordhash.slices(batch.column(1)):
                words = wordhash.Words(data, offsets, lower=False)
                second = words.second_hashes()
                for k, (a, b) in enumerate(words.documents()):
                    own = words.hashes[a:b]
                    chosen = np.flatnonzero(np.isin(window_anchors(own, window), listed[i + k].values.to_numpy().view(np.uint64)))
                    rows.append(np.full(len(chosen), i + k))
                    high.append(wordhash.sequence_hashes(own, window)[chosen])
                    low.append((wordhash.sequence_hashes(second[a:b], window, second=True)[chosen] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    place.append(chosen.astype(np.int32))
                    pending += len(chosen)
                if pending > 100_000:
                    yield flush()
                    rows, high, low, place, pending = [], [], [], [], 0
            if rows:
                yield flush()

    return df.mapInArrow(cut, f"high long, low int, doc_id {id_type}, text_hash long, position int")


def _cut(df: DataFrame, id_type: str, window: int, with_text: bool) -> DataFrame:
    """(doc_id, text_hash, lost, kept: sha256 or text) of (doc_id, text, text_hash, positions)."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = batch.column(3)
            removed, kept = [], []
            for i, words, raw in wordhash.documents(batch.column(1), lower=False):
                starts = positions[i].values.to_numpy()
                covered = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(covered, starts, 1)
                np.add.at(covered, starts + window, -1)
                covered = np.cumsum(covered)[:-1] > 0
                text = b" ".join(w for w, gone in zip(raw.tobytes().split(), covered.tolist(), strict=True) if not gone)
                removed.append(int(covered.sum()))
                kept.append(text.decode() if with_text else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "text_hash", "lost", "kept"])

    return df.mapInArrow(remove, f"doc_id {id_type}, text_hash long, lost long, kept string")


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts in a document with a smaller id.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and,
    with ``with_text``, kept_text, which is null where nothing was removed and the text stands as it was.

    Windows are judged on the input. Null texts have no words; documents under ``window`` words lose none. Repeats inside
    one document stay. Rows that repeat an id count as one document: they take nothing from each other. A row with a null id
    has no place in the order of ids, so it neither loses words nor makes others lose any. Extra columns are ignored; an
    empty table gives no rows.
    """
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    scanned = stage(_scan(texts, id_type, window))

    firsts = stage(scanned.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id")))  # staged, so that a hot digest can be split
    judged = scanned.join(firsts, "digest", "left").withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    # equal rows count once
    anchors = stage(judged.filter("not is_copy and doc_id is not null and anchors is not null").groupBy("doc_id", "text_hash").agg(F.first("anchors").alias("anchors")))
    total = anchors.agg(F.sum(F.size("anchors"))).first()[0] or 0
    bits = max(MIN_BITS, (CELLS_PER_ANCHOR * total).bit_length())
    crowded = stage(_crowded_cells(anchors, bits))

    suspects = _suspects(anchors, crowded, bits)
    suspected = stage(texts.join(suspects, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "anchors").dropDuplicates(["doc_id", "text_hash"]))
    windows = stage(_windows(suspected, id_type, window))
    # staged, so that adaptive execution can split the windows of a passage that very many documents share
    owners = stage(windows.groupBy("high", "low").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("high", "low", "owner"))
    places = stage(windows.join(owners, ["high", "low"]).filter("doc_id > owner").groupBy("doc_id", "text_hash").agg(F.collect_list("position").alias("positions")))
    release(anchors, crowded, windows, owners)
    changed = _cut(suspected.join(places, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "positions"), id_type, window, with_text)

    out = judged.select("doc_id", "text_hash", "n_words", "is_copy", "kept_sha256").join(changed, ["doc_id", "text_hash"], "left")
    sha = F.sha2(F.col("kept").cast("binary"), 256) if with_text else F.col("kept")
    columns = [
        "doc_id",
        "n_words",
        F.when(F.col("is_copy"), F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("is_copy"), F.lit(EMPTY_SHA256)).when(F.col("kept").isNotNull(), sha).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(F.col("is_copy"), F.lit("")).otherwise(F.col("kept")).alias("kept_text"))
    return out.select(*columns)
