"""Toxicity by a weighted lexicon, matched after folding.

A text is folded: letters of other scripts that look like Latin ones become those, digits and signs that stand for letters inside a word become
letters, invisible characters go, and what is left are words of letters with one space between them. An Aho-Corasick automaton finds all terms of
the lexicon in one pass over that. A term is a whole word, a phrase, or the beginning of a longer word; a match inside an exception phrase does not count, and
the heaviest match at a place is the one that does. The weights of a text are summed, set against its length, and put on a scale from 0 to 1.

A fixed part of the lexicon is given here; the rest, all weights and the scale are learned from labelled rows. A learned term must stand in
toxic texts after many different words, so that a group of copies of one text teaches nothing by its size.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwire.llm.scratch import stage

# Words of insult and contempt, and phrases in which one of them is none.
TERMS = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "stupid", "stupidity", "dumb", "dumbass", "clown", "loser", "losers", "scum", "scumbag", "trash", "garbage", "vermin", "parasite",
    "pathetic", "worthless", "useless", "disgusting", "disgrace", "filthy", "pig", "creep", "freak", "jerk", "bastard", "bitch", "asshole", "shithead", "dickhead", "retard", "degenerate", "lowlife", "shut up", "drop dead",
)
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "take out the trash", "trash folder", "garbage collection", "garbage collector", "garbage truck", "garbage can", "clown fish", "circus clown", "class clown",
    "guinea pig", "pig farm", "pig iron", "host parasite", "parasite infection", "useless statement", "sore loser", "dumb terminal", "dumb waiter", "freak accident", "freak wave", "knee jerk", "jerk chicken",
)
# Characters that look like a Latin letter, and those that stand for one.
HOMOGLYPHS = {
    "a": "\u0430\u0251\u03b1", "b": "\u044c\u0432\u03b2", "c": "\u0441\u03f2", "d": "\u0501", "e": "\u0435\u0454\u03b5", "g": "\u0261", "h": "\u04bb\u043d", "i": "\u0456\u0131\u03b9", "j": "\u0458\u03f3", "k": "\u043a\u03ba", "l": "\u04cf", "m": "\u043c",
    "n": "\u043f\u0578", "o": "\u043e\u03bf\u0585", "p": "\u0440\u03c1", "q": "\u051b", "r": "\u0433", "s": "\u0455", "t": "\u0442\u03c4", "u": "\u03c5\u057d", "v": "\u0475\u03bd", "w": "\u051d\u03c9", "x": "\u0445\u03c7", "y": "\u0443\u03b3",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}

#: Labelled rows that are learned from, at most; which ones is decided by a hash of their ids.
MAX_LABELLED = 20_000
#: Learned terms, at most: the heaviest.
MAX_TERMS = 2_000
#: A learned term stands in toxic texts after so many different words at least, and is so much more likely there (natural logarithm).
LEAST_CONTEXTS, LEAST_WEIGHT = 6, 2.5
#: Beginnings of words that can be terms.
STEM_LENGTHS = range(4, 9)
#: Words added to a text's length, so that one match in a short text isn't all of it.
PADDING = 30
#: Weight of a given term that the labels say nothing of; scale of texts without enough labels (intercept, slope).
GIVEN_WEIGHT, GIVEN_SCALE = 5.0, (-4.0, 4.0)

_TABLE = str.maketrans({c: latin for latin, like in HOMOGLYPHS.items() for c in like} | {c: None for c in "\u00ad\u200b\u200c\u200d\u2060\ufeff"})
_STANDS_FOR = str.maketrans(DIGITS | SIGNS)
_LETTER = r"[^\W\d_]"
#: Characters that stand for letters, inside a word or in front of one; digits also at its end.
_INSIDE = re.compile(rf"[@$!|0-9]+(?={_LETTER})|(?<={_LETTER})[0-9]{{1,2}}(?![0-9])")
_WORD = re.compile(rf"{_LETTER}+")
_HAS_SIGN = re.compile(r"[@$!|0-9]")
_BEYOND = re.compile(r"[^\x00-\xFF]")


def fold(text: str) -> str:
    """A text's words, one space apart and around them, as they read."""
    if _BEYOND.search(text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_TABLE)
    if _HAS_SIGN.search(text):
        text = _INSIDE.sub(lambda m: m[0].translate(_STANDS_FOR), text)
    words = _WORD.findall(text)
    return " " + " ".join(words) + " " if words else " "


class Lexicon(NamedTuple):
    """``terms``: weight by term, as it stands in folded texts (`` word `` or `` beginning``); ``scale``: intercept and slope."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    scale: tuple[float, float]


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.scale = lexicon.scale
        self.automaton = ahocorasick.Automaton()
        found: dict[str, tuple[float, bool]] = {fold(x): (0.0, True) for x in lexicon.exceptions}
        for term, weight in lexicon.terms.items():
            found.setdefault(term, (weight, False))
        for pattern, (weight, excepted) in found.items():
            if pattern.strip():
                self.automaton.add_word(pattern, (len(pattern), weight, excepted))
        self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of what counts, in order: the heaviest term at each place, the longest among equals."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[float, int]] = {}
        excepted = []
        for last, (length, weight, is_exception) in self.automaton.iter(folded):
            start = last - length + 1
            if is_exception:
                excepted.append((start, last + 1))
            elif folded[last] == " " or folded[last + 1] != " ":  # a beginning has more to follow
                best[start] = max(best.get(start, (0.0, 0)), (weight, last + 1))
        out, k, reach = [], 0, 0
        excepted.sort()
        for start in sorted(best):
            weight, end = best[start]
            while k < len(excepted) and excepted[k][0] <= start:
                reach = max(reach, excepted[k][1])
                k += 1
            if end > reach:
                out.append((start, end, weight))
        return out

    def density(self, folded: str) -> tuple[int, float, float]:
        """(matches, their weight, logarithm of one more than their weight in 100 words)."""
        found = self.matches(folded)
        weight = math.fsum(w for _, _, w in found)
        return len(found), weight, math.log1p(100 * weight / (folded.count(" ") - 1 + PADDING))

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, self.scale[0] + self.scale[1] * density)))


def is_held_out(doc_id: Column, folds: int = 3, fold_of: int = 1) -> Column:
    """Whether a row is kept from learning: by the crc32 of its id as text; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold_of, F.lit(True))


def _labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(toxic, folded) of the labelled rows to learn from; a text that several rows share, with one label, is one."""
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("_id")))
    chosen = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")  # of MAX_LABELLED rows at most

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(x or "") for x in batch.column(1).to_pylist()], pa.string())], ["toxic", "folded"])

    return texts.select("toxic", "text").mapInArrow(folded, "toxic int, folded string").distinct()


def _terms_of(word: str) -> Iterator[str]:
    yield f" {word} "
    for k in STEM_LENGTHS:
        if k < len(word):
            yield " " + word[:k]


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, term, before): each term of a text once, and the crc32 of the word before it where it stands first."""
    for batch in batches:
        for toxic, folded in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first: dict[str, str] = {}
            before = ""
            for word in folded.split():
                for term in _terms_of(word):
                    first.setdefault(term, before)
                before = word
            places = [zlib.crc32(x.encode()) for x in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(first), pa.int32()), pa.array(list(first), pa.string()), pa.array(places, pa.int64())], ["toxic", "term", "before"])


def _pruned(weights: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Of terms that stand for each other, one: a beginning goes if a longer one is as frequent, a longer term if a shorter is about as telling."""
    longer: dict[str, int] = {}
    for term, (_, n) in weights.items():
        for k in range(5, len(term)):
            longer[term[:k]] = max(longer.get(term[:k], 0), n)
    telling = {t: w for t, (w, n) in weights.items() if longer.get(t, 0) < 0.9 * n}
    kept: dict[str, float] = {}
    for term in sorted(telling, key=lambda t: (len(t), t)):
        if not any(kept.get(term[:k], -1.0) >= telling[term] - 0.7 for k in range(5, len(term))):
            kept[term] = telling[term]
    return kept


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic regression with a slight pull to 0, by Newton's method."""
    a = np.stack([np.ones(len(x)), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: tuple[str, ...] = TERMS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon from ``labels`` (id, toxic), of rows that aren't held out, and the texts of ``df``; without both kinds of labels, as it is given."""
    sample = stage(_labelled(df, labels, id_col, text_col))
    n = {row.toxic: row["count"] for row in sample.groupBy("toxic").count().collect()}
    given = {fold(x): GIVEN_WEIGHT for x in terms}
    if len(n) < 2:
        return Lexicon(given, exceptions, GIVEN_SCALE)
    places = sample.repartition(32, "folded").mapInArrow(_first_places, "toxic int, term string, before long")
    by_context = places.groupBy("term", "toxic", "before").agg(F.count("*").alias("n"))
    counts = by_context.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("contexts"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"))
    weight = F.log((F.col("contexts") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    told = counts.filter(F.col("contexts") >= LEAST_CONTEXTS).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT)
    rows = told.orderBy(F.desc("weight"), F.desc("contexts"), "term").limit(MAX_TERMS).collect()
    learned = given | _pruned({row.term: (row.weight, row.contexts) for row in rows})
    matcher = Matcher(Lexicon(learned, exceptions, GIVEN_SCALE))

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.density(x)[2] for x in batch.column(1).to_pylist()], pa.float64())], ["toxic", "density"])

    told = sorted(sample.mapInArrow(densities, "toxic int, density double").collect(), key=lambda x: (x.density, x.toxic))  # two numbers of MAX_LABELLED rows at most
    scale = _scale(np.array([x.density for x in told]), np.array([x.toxic for x in told], dtype=float))
    return Lexicon(learned, exceptions, scale if scale[1] > 0 else GIVEN_SCALE)


def score_toxicity(df: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the columns ``keep``), n_words, n_matches, weight and score (0 to 1) of every row.

    Null and empty texts have no words and the score of a text without matches. A score follows from the text alone: equal texts have equal scores,
    and repeated rows are scored each time. Texts are read whole. Other columns are left alone; an empty table gives no rows.
    """
    fitted = df.sparkSession.sparkContext.broadcast(lexicon)  # the given terms and MAX_TERMS learned ones at most
    given = df.select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(fitted.value)
        for batch in batches:
            words, matches, weights, scores = [], [], [], []
            for text in batch.column(1):
                folded = fold(text.as_py() or "")
                n, weight, density = matcher.density(folded)
                words.append(folded.count(" ") - 1)
                matches.append(n)
                weights.append(weight)
                scores.append(matcher.score(density))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(matches, pa.int64()), pa.array(weights, pa.float64()), pa.array(scores, pa.float64())], ["row", "n_words", "n_matches", "weight", "score"])

    numbers = [T.StructField(c, t) for c, t in (("n_words", T.LongType()), ("n_matches", T.LongType()), ("weight", T.DoubleType()), ("score", T.DoubleType()))]
    return given.mapInArrow(scored, T.StructType([given.schema["row"], *numbers]))
