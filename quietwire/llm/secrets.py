"""Secrets in texts: fixed forms, and values in credential contexts that would take long to guess.

The guess cost of a value is the least sum, over its segmentations, of the base-2 logarithms of the guesses for each
segment. Segments are dictionary words, dates, repeats, keyboard walks, and brute force over the character classes
used. Values that people reach by words and patterns cost little; random ones cost their length.

The dictionary is a few ranked lists, and a word costs its best rank: usual parts of passwords, the whole words of a public
tokenizer's vocabulary, which stand in the order in which they were merged, and the commonest words of the corpus itself.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.llm.scratch import release, stage

#: Forms fixed by contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Where a value is taken for a credential: a name, then a separator, then a run without spaces, quotes or separators.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)["']?(?:\x20{0,4}(?::|=>?)\x20{0,4}|\x20{1,4}is\x20{1,4})["']?([^\s"'`<>,;(){}\[\]]{6,})""",
    re.ASCII | re.IGNORECASE,
)
#: Bits of guessing from which a value counts as a secret.
MIN_BITS = 36.0
#: Words that are taken from the corpus at most; they are passed to every task.
CORPUS_WORDS = 20_000

#: Common parts of passwords, most usual first; the rank is the number of guesses.
COMMON_WORDS = tuple(
    "password admin welcome login user test guest root master hello love dragon monkey sunshine princess football baseball shadow letmein "
    "superman batman michael jordan hunter summer winter spring autumn secret token value none null true false example changeme default "
    "required string your here this that the and with from have not key access private public api service account email name number code "
    "house horse staple correct battery computer internet server database system office company school family friend music money".split()
)
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")
_NEXT = {(a, b) for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])(?:[-./]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-./](?:0?[1-9]|1[0-2])[-./](?:19|20)?\d\d")
_LEET = str.maketrans("013457@$", "oieastas")
#: Bits to say which kind the next segment has.
_KIND_BITS = 2.0
_DATE_BITS = math.log2(365 * 120)


def vocabulary_words(path: str) -> list[str]:
    """The whole words (of three letters or more) of a rank file, in the order of their ranks."""
    with open(path, "rb") as lines:
        tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    words = (token[1:].decode().lower() for _, token in tokens if re.fullmatch(rb" [A-Za-z]{3,}", token))
    return list(dict.fromkeys(words))


def corpus_words(df: DataFrame, text_col: str = "text", size: int = CORPUS_WORDS, min_rows: int = 10) -> list[str]:
    """The ``size`` words of a to z that stand in most rows of the whole table, in ``min_rows`` at the least, most usual first.

    Values in credential contexts are left out, so that no secret becomes a word by being copied.
    """
    prose = F.regexp_replace(F.lower(F.col(text_col).cast("string")), "(?i)" + CONTEXT.pattern, " ")
    words = df.select(F.explode(F.array_distinct(F.regexp_extract_all(prose, F.lit("[a-z]{3,24}"), 0))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows)
    counts = stage(counts.withColumn("class", F.floor(F.log2("n") * 16).cast("int")))
    # only the classes that hold the commonest words go to the driver, not so many words of every partition
    left, least = size, 0
    for r in sorted(counts.groupBy("class").agg(F.count("*").alias("words")).collect(), reverse=True):
        left, least = left - r["words"], r["class"]
        if left <= 0:
            break
    found = [r.word for r in counts.filter(F.col("class") >= least).orderBy(F.desc("n"), "word").limit(size).collect()]
    release(counts)
    return found


def _class_bits(char: str) -> float:
    if char.isdigit():
        return math.log2(10)
    if char.isalpha():
        return math.log2(26) + (char != char.lower())
    return math.log2(33)


def _case_bits(word: str) -> float:
    """Guesses for the capitals of a word: none, the first letter or all are usual; other choices are counted."""
    capitals = sum(x != x.lower() for x in word)
    if not capitals:
        return 0.0
    return 1.0 if capitals == len(word) or (capitals == 1 and word[0] != word[0].lower()) else 1.0 + math.log2(math.comb(len(word), capitals))


class GuessCost:
    """Guess cost in bits, for ranked lists of words."""

    def __init__(self, *lists: Iterable[str]):
        self.bits: dict[str, float] = {}
        for words in lists or (COMMON_WORDS,):
            for rank, word in enumerate(words, 2):
                self.bits[word.lower()] = min(math.log2(rank), self.bits.get(word.lower(), math.inf))
        self.longest = max(map(len, self.bits), default=0)

    def __call__(self, value: str) -> float:
        n = len(value)
        low = value.lower()
        if len(low) != n:  # a few letters change length in lower case
            low = value
        plain = low.translate(_LEET)
        best = [math.inf] * (n + 1)
        best[0] = 0.0
        brute = math.inf  # least cost of a segmentation that ends in an open brute-force span
        for i in range(n):
            here = best[i]
            # words, also with letters replaced by look-alikes
            for j in range(i + 1, min(n, i + self.longest) + 1):
                for text, extra in ((low, 0.0), (plain, 1.0)):
                    bits = self.bits.get(text[i:j])
                    if bits is not None:
                        best[j] = min(best[j], here + _KIND_BITS + bits + extra + _case_bits(value[i:j]))
            if value[i] in "0123456789":  # dates of every length
                for j in range(i + 4, min(n, i + 10) + 1):
                    if _DATE.fullmatch(value, i, j):
                        best[j] = min(best[j], here + _KIND_BITS + _DATE_BITS)
            # the same character again and again, and a step along a key row: a start and a length
            for follows in (lambda x, y: x == y, lambda x, y: (x, y) in _NEXT):
                j = i + 1
                while j < n and follows(low[j - 1], low[j]):
                    j += 1
                    if j - i >= 3:
                        best[j] = min(best[j], here + _KIND_BITS + math.log2(94) + math.log2(j - i))
                    if j - i >= 64:  # a longer run goes on as another segment
                        break
            brute = min(here + _KIND_BITS, brute) + _class_bits(value[i])
            best[i + 1] = min(best[i + 1], brute)
        return best[n]


def find_spans(text: str, cost: GuessCost, min_bits: float = MIN_BITS) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every secret, in order."""
    spans = []
    if ":" in text or "=" in text or " is " in text.lower():
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if cost(m[1]) >= min_bits]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Iterable[Iterable[str]] = (COMMON_WORDS,), min_bits: float = MIN_BITS) -> DataFrame:
    """Spans of secrets in every text, in code points with an exclusive end.

    Returns one row per input row: doc_id, n_assign, n_access, n_hex, n_guess, base (the spans of the three fixed forms),
    spans (all spans); both as kind:start:end by start, then kind as listed, comma-joined. Kind ``guess`` marks a value in
    a credential context whose guess cost, by the ranked lists ``words``, is at least ``min_bits``.

    Null and empty texts have no spans; repeated rows are scanned alike. Extra columns are ignored; an empty table gives no rows.
    """
    lists = df.sparkSession.sparkContext.broadcast([list(x) for x in words])  # bounded: see corpus_words
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(*lists.value)
        for batch in batches:
            found = [find_spans(x, cost, min_bits) if x else [] for x in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in found], pa.int64()) for kind in range(4)]
            base = pa.array([_joined([x for x in spans if x[1] < 3]) for spans in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base.cast(pa.string()), pa.array([_joined(x) for x in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base", "spans"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_guess long, base string, spans string")

