"""Rates for documents, so that a corpus meets target weights by domain.

A classifier trained on the labelled table gives every document a posterior over domains. A document with n tokens, rate r and
posterior p adds r * n * p to the domains' expected tokens. Accelerated projected gradient descent finds nonnegative
rates whose totals come closest to the targets in least squares, starting from rate 1 for all. The gradient of a
document's rate depends on the others only through the totals, one number for each domain, so that is all that an
iteration gathers; a document's rate follows from its posterior and the steps so far. The momentum starts anew where it
points uphill. The descent ends when a step moves no domain's share by more than TOLERANCE; ``Fit`` says whether it did, and what is left.

Most steps need no job of their own. One job sums tokens and posteriors in at most CELLS cells of like posteriors, and the first steps
are worked out on these sums. Every document then takes the same steps, its exact totals are gathered, and the descent goes on from there
over all documents, a job a step for all targets together, until it ends by the rule above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwire.llm import wordhash
from quietwire.llm.scratch import release, stage

#: At most so many labelled documents train the classifier; which ones is decided by a hash of their ids.
MAX_LABELLED = 20_000
#: Hash buckets of the classifier's word features.
FEATURES = 1 << 14
#: Iterations at most, on the cells and then over all documents; ``Fit.converged`` is false where they did not do.
ITERATIONS = 200
#: Largest change of a domain's share of all tokens in the last step.
TOLERANCE = 1e-5
#: Iterations after which the state of the descent is written down.
WRITTEN = 10
#: Cells of posteriors on which the first steps are worked out.
CELLS = 4096


def label_domain() -> Column:
    """Domains of the labels table: toxic, else junk (quality 0), else clean."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")


def _features(words: np.ndarray) -> np.ndarray:
    """Distinct hash buckets of a document's words."""
    return np.unique(words % np.uint64(FEATURES)).astype(np.int32)


def _train(df: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(weights by domain and bucket, intercepts) of a multinomial logistic regression on the labelled sample."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).alias("at")).filter("doc_id is not null and at > 0")
    chosen = known.groupBy("doc_id").agg((F.min("at") - 1).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = [_features(words) for _, words, _ in wordhash.documents(batch.column(1), lower=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets, pa.list_(pa.int32()))], ["label", "buckets"])

    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # of MAX_LABELLED rows at most
    sample = stage(texts.select("label", "text").mapInArrow(hashed, "label double, buckets array<int>"))
    weights, intercepts = np.zeros((len(domains), FEATURES)), np.zeros(len(domains))
    seen = [int(x.label) for x in sample.select("label").distinct().orderBy("label").collect()]
    if len(seen) < 2:  # nothing to tell apart: all belong to the one domain labelled, or equally to all
        intercepts[[i for i in range(len(domains)) if seen and i != seen[0]]] = -50.0
        return weights, intercepts
    place = CountVectorizerModel.from_vocabulary([str(i) for i in range(FEATURES)], inputCol="words", outputCol="features")
    given = place.transform(sample.select("label", F.col("buckets").cast("array<string>").alias("words"))).select("label", "features")
    model = LogisticRegression(maxIter=25, regParam=5e-4, family="multinomial").fit(given)
    fitted = model.coefficientMatrix.toArray()
    weights[: len(fitted)], intercepts[: len(fitted)] = fitted, model.interceptVector.toArray()
    intercepts[len(fitted) :] = -50.0
    return weights, np.maximum(intercepts, -50.0)


def domain_posteriors(df: DataFrame, labels: DataFrame, domains: list[str], keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row: the columns ``keep``, n_tokens, posterior) for every row; ``labels`` has the id column and ``domain``."""
    fitted = df.sparkSession.sparkContext.broadcast(_train(df, labels, domains, id_col, text_col))  # domains times FEATURES numbers

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercepts = fitted.value
        by_bucket = np.ascontiguousarray(weights.T)
        for batch in batches:
            counts, scores = [], []
            for _, words, _ in wordhash.documents(batch.column(1), lower=False):
                counts.append(len(words))
                scores.append(by_bucket[_features(words)].sum(axis=0) + intercepts)
            scores = np.array(scores).reshape(-1, len(intercepts))
            shares = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
            shares = shares / shares.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(list(shares), pa.list_(pa.float64()))], ["row", "n_tokens", "posterior"])

    given = df.select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(predict, T.StructType([given.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]))


class Fit(NamedTuple):
    """What gives every document's rate, and how well it does."""

    #: (residual, momentum) of each step.
    steps: list[tuple[np.ndarray, float]]
    converged: bool
    #: Largest difference between a domain's expected share of the tokens at these rates and its target.
    gap: float


def rates_after(posteriors: np.ndarray, steps: list[tuple[np.ndarray, float]], rates: np.ndarray | None = None, points: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rates, points at which the next gradient is taken) after some projected steps, from rate 1 or from a given state."""
    if rates is None or points is None:
        rates = points = np.ones(len(posteriors))
    for residual, momentum in steps:
        # posteriors sum to 1, so the largest eigenvalue of their weighted second moments, and with it the step, is at most 1
        following = np.maximum(0.0, points - posteriors @ residual)
        points = following + momentum * (following - rates)
        rates = following
    return rates, points


class _Descent:
    """One target's descent: the steps so far and the domains' totals, as shares of all tokens, that they lead to."""

    def __init__(self, targets: np.ndarray, totals: np.ndarray):
        self.targets, self.at_rates, self.at_points = targets, totals, totals
        self.steps: list[tuple[np.ndarray, float]] = []
        self.pace, self.converged = 1.0, False

    def proposed(self) -> tuple[np.ndarray, float]:
        self.following = (1 + math.sqrt(1 + 4 * self.pace * self.pace)) / 2
        return self.at_points - self.targets, (self.pace - 1) / self.following

    def take(self, step: tuple[np.ndarray, float], rates: np.ndarray, points: np.ndarray, tolerance: float) -> None:
        """Take a proposed step that leads to these totals, without its momentum if that would point uphill."""
        if step[0] @ (rates - self.at_rates) > 0:
            self.following, step, points = 1.0, (step[0], 0.0), rates
        self.converged = bool(np.abs(rates - self.at_rates).max() < tolerance)
        self.steps.append(step)
        self.pace, self.at_rates, self.at_points = self.following, rates, points

    def on_cells(self, weights: np.ndarray, posteriors: np.ndarray) -> None:
        """The first steps, for a few weighted posteriors. The last one has no momentum, so that points are rates."""
        state = (None, None)
        while len(self.steps) < ITERATIONS and not self.converged:
            step = self.proposed()
            self.take(step, *((np.stack(rates_after(posteriors, [step], *state)) * weights) @ posteriors), TOLERANCE / 10)
            state = rates_after(posteriors, self.steps[-1:], *state)
        self.steps[-1] = (self.steps[-1][0], 0.0)
        self.pace, self.converged = 1.0, False


def _cells(stats: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, mean posterior) of cells of documents whose posteriors are alike: at most CELLS and those at the rim, whatever the number of documents."""
    fineness = max(r for r in range(1, CELLS) if r == 1 or math.comb(r + k - 1, k - 1) <= CELLS)
    shares = [F.get("posterior", F.lit(i)) for i in range(k)]
    cell = [F.floor(x * fineness).alias(f"c{i}") for i, x in enumerate(shares[:-1])]
    sums = stats.groupBy(*cell).agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * x).alias(f"a{i}") for i, x in enumerate(shares)]).filter("n > 0")
    rows = np.array(sums.orderBy(*[f"c{i}" for i in range(k - 1)]).select("n", *[f"a{i}" for i in range(k)]).collect(), dtype=float).reshape(-1, k + 1)
    return rows[:, 0], rows[:, 1:] / rows[:, :1]


def fit_rates(stats: DataFrame, targets: list[list[float]], keep_domain: int) -> list[Fit]:
    """Fit rates to ``stats`` (n_tokens, posterior) for each target, all in the same passes.

    A target's weights are taken times a total at which the domain ``keep_domain`` keeps the tokens that it has.
    """
    k = len(targets[0])
    tokens, means = _cells(stats, k)
    everything = tokens.sum()
    if not everything:
        return [Fit([], True, 0.0) for _ in targets]
    weight = tokens / everything
    totals = weight @ means
    shares = [np.array(x) / sum(x) for x in targets]
    descents = [_Descent(x * (totals[keep_domain] / x[keep_domain] if x[keep_domain] else 1.0), totals) for x in shares]
    for descent in descents:
        descent.on_cells(weight, means)

    def advance(steps: list[list[tuple[np.ndarray, float]]]):
        """Of a batch of the state: token counts, posteriors, and each target's (rates, points) after further steps."""

        def at(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
            posteriors = np.asarray(batch.column(1).flatten()).reshape(-1, k)
            known = [np.asarray(x) for x in batch.columns[2:]]
            return np.asarray(batch.column(0), dtype=float), posteriors, [rates_after(posteriors, x, *known[2 * i : 2 * i + 2]) for i, x in enumerate(steps)]

        return at

    def gathered(state: DataFrame, steps: list[list[tuple[np.ndarray, float]]]) -> np.ndarray:
        """Each target's totals by domain at the rates and at the points, as shares of all tokens."""
        at = advance(steps)
        names = [f"a{i}" for i in range(len(steps) * 2 * k)]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(steps), 2, k))
            for batch in batches:
                n, posteriors, states = at(batch)
                total += (np.array(states) * n) @ posteriors
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.ravel()], names)

        row = state.mapInArrow(part, ", ".join(f"{x} double" for x in names)).agg(*[F.sum(x).alias(x) for x in names]).first()
        return np.array(row, dtype=float).reshape(len(steps), 2, k) / everything

    def written(state: DataFrame, steps: list[list[tuple[np.ndarray, float]]]) -> DataFrame:
        at = advance(steps)
        names = [f"{x}{i}" for i in range(len(steps)) for x in ("rate", "point")]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [pa.array(x) for pair in at(batch)[2] for x in pair]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["n_tokens", "posterior", *names])

        return stage(state.select("*").mapInArrow(rows, ", ".join(["n_tokens long, posterior array<double>", *(f"{x} double" for x in names)])))

    state = written(stats.select("n_tokens", "posterior"), [x.steps for x in descents])
    since: list[list[tuple[np.ndarray, float]]] = [[] for _ in descents]
    for descent, (rates, points) in zip(descents, gathered(state, since), strict=True):
        descent.at_rates, descent.at_points = rates, points
    for iteration in range(1, ITERATIONS + 1):
        if all(x.converged for x in descents):
            break
        # with the momentum of this step left out first, the totals say whether it would point uphill
        steps = [None if x.converged else x.proposed() for x in descents]
        reached = gathered(state, [past + [step] * (step is not None) for past, step in zip(since, steps, strict=True)])
        for descent, step, past, (rates, points) in zip(descents, steps, since, reached, strict=True):
            if step is not None:
                descent.take(step, rates, points, TOLERANCE)
                past.append(descent.steps[-1])
        if iteration % WRITTEN == 0:
            before, state = state, written(state, since)
            since = [[] for _ in descents]
            release(before)
    release(state)
    return [Fit(x.steps, x.converged, float(np.abs((x.at_rates / x.at_rates.sum() if x.at_rates.sum() else x.at_rates) - share).max())) for x, share in zip(descents, shares, strict=True)]


def score_documents(df: DataFrame, labels: DataFrame, domains: list[str], keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``domain_posteriors``, staged, so that texts are read once however many targets are fitted."""
    return stage(domain_posteriors(df, labels, domains, keep, id_col, text_col))


def with_rates(scored: DataFrame, fits: dict[str, Fit]) -> DataFrame:
    """Scored documents with a column of rates for each fit."""
    at, steps = scored.columns.index("posterior"), {name: fit.steps for name, fit in fits.items()}

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            posteriors = np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rates_after(posteriors, x)[0]) for x in steps.values())], [*batch.schema.names, *steps])

    return scored.mapInArrow(rate, T.StructType([*scored.schema.fields, *(T.StructField(name, T.DoubleType()) for name in steps)]))


def copies(rate: Column, doc_id: Column) -> Column:
    """A rate as a whole number, up or down by a hash of the id so that totals hold; without an id, the nearest number."""
    chance = F.shiftrightunsigned(F.xxhash64(doc_id), 11) / F.lit(float(1 << 53))
    return F.floor(rate + F.when(doc_id.isNull(), 0.5).otherwise(1 - chance)).cast("long")


#: Targets of the pipeline: all tokens from clean documents.
TARGETS = {"clean": 1.0, "junk": 0.0, "toxic": 0.0}
#: Targets of a mix that some of everything belongs to.
BLEND = {"clean": 0.8, "junk": 0.15, "toxic": 0.05}


def mixing_rates(df: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, keep_domain: str = "clean", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rate of every document for target weights by domain.

    Returns one row per input row: doc_id, n_tokens (words), posterior (by domain, in the order of ``weights``), domain (the
    likeliest), rate, copies (``copies`` of the rate), gap and converged (of the whole fit, see ``Fit``).

    ``labels`` has the id column and ``domain``; domains without a weight are not used. Null and empty texts have no tokens and
    a posterior from the classifier's intercept. Without labels every domain is as likely. Repeated rows count each
    time and get equal rates. Other columns are ignored; an empty table gives no rows.
    """
    weights = weights or TARGETS
    domains = list(weights)
    scored = score_documents(df, labels, domains, [id_col], id_col, text_col)
    fit = fit_rates(scored, [list(weights.values())], domains.index(keep_domain))[0]
    out = with_rates(scored, {"rate": fit}).select(F.col("row")[id_col].alias("doc_id"), "n_tokens", "posterior", likeliest(domains).alias("domain"), "rate")
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).withColumns({"gap": F.lit(fit.gap), "converged": F.lit(fit.converged)})


def likeliest(domains: list[str]) -> Column:
    """The domain of the largest posterior, the first of equal ones."""
    return F.get(F.array(*map(F.lit, domains)), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)


def filter_mixed(df: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, keep_domain: str = "clean", min_rate: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, whose rate is at least ``min_rate``: a mix that takes each document once or not at all."""
    weights = weights or TARGETS
    scored = score_documents(df, labels, list(weights), df.columns, id_col, text_col)
    fit = fit_rates(scored, [list(weights.values())], list(weights).index(keep_domain))[0]
    return with_rates(scored, {"rate": fit}).filter(F.col("rate") >= min_rate).select("row.*")
