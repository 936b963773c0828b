"""Quality rules in DataFrame expressions: counts per document, and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are counted, one from
all trusted labelled documents, one from all documents. A document's score is the mean, over its
n-grams, of log p(trusted) - log p(corpus); documents under a fixed threshold are rejected. The only thing that
leaves the executors is one weight for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of other characters than these.
SPACES = r"[\x20\x09-\x0D]+"
#: Hash buckets for words, and as many for pairs.
BUCKETS = 8192
#: Mean log-likelihood ratio under which a document is rejected.
THRESHOLD = -0.1
#: Added to each bucket's count.
SMOOTHING = 1.0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def ngram_buckets(words: Column) -> Column:
    """Bucket of each word and of each pair of neighbouring words; pairs have the upper half of the buckets."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    pair = F.transform(F.slice(words, 2, F.size(words)), lambda w, i: (F.pmod(F.xxhash64(F.get(words, i), w), F.lit(BUCKETS)) + BUCKETS).cast("int"))
    return F.concat(single, pair)


def likelihood_ratio_weights(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row with ``weights``, an array of log p(trusted) - log p(corpus) by bucket."""
    trusted_ids = trusted.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct()
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the ids grow with the labels: they meet the texts by a shuffle at every size, never whole in each task
    met = texts.join(trusted_ids.withColumn("is_trusted", F.lit(1)).hint("merge"), "doc_id", "left")
    marked = met.select("is_trusted", words_of(F.col("text")).alias("words"))
    grams = marked.select(F.coalesce("is_trusted", F.lit(0)).alias("is_trusted"), F.explode(ngram_buckets(F.col("words"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("corpus"), F.sum("is_trusted").alias("trusted"))
    every = df.sparkSession.range(2 * BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    row = every.agg(F.sum("corpus").alias("n_corpus"), F.sum("trusted").alias("n_trusted"), F.array_sort(F.collect_list(F.struct("bucket", "corpus", "trusted"))).alias("cells"))

    def share(count: Column, total: Column) -> Column:
        return F.log((count + SMOOTHING) / (total + SMOOTHING * 2 * BUCKETS))

    return row.select(F.transform("cells", lambda c: share(c["trusted"], F.col("n_trusted")) - share(c["corpus"], F.col("n_corpus"))).alias("weights"))


def _worked_out_once(condition: Column) -> Column:
    """A condition that no filter on it is moved below: there, the counts that it needs would be worked out again and again."""
    return condition & (F.monotonically_increasing_id() >= 0)


def _judged(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(row: all given columns, and the counts and verdict) for every row."""
    trusted = labels.filter("quality = 1 and coalesce(toxic, 0) = 0")
    weights = likelihood_ratio_weights(df, trusted, id_col, text_col).scalar()
    given = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = given.select("row", "text", words_of(F.col("text")).alias("words"))
    hashed = split.select(
        "row",
        "text",
        F.size("words").cast("long").alias("n_words"),
        ngram_buckets(F.col("words")).alias("grams"),
        F.when(F.size("words") < 5, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)])))
        .alias("windows"),
    )
    has_repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = hashed.select("row", "text", "n_words", "grams", F.when(has_repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("sorted"))

    def repeats(x: Column, j: Column) -> Column:
        same = [F.coalesce(F.get("sorted", j + step)["h"] == x["h"], F.lit(False)) for step in (-1, 1)]
        return same[0] | same[1]

    starts = placed.select("row", "text", "n_words", "grams", F.array_sort(F.transform(F.filter("sorted", repeats), lambda x: x["i"])).alias("starts"))
    starts = starts.withColumn("weights", weights)
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc: Column, x: Column) -> Column:
        end = x.cast("long") + 5
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], x.cast("long"))).alias("n"))

    plain = F.col("text")
    for space in " \t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(space), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = starts.select(
        "row",
        "n_words",
        F.char_length(plain).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.aggregate("starts", zero, cover)["n"].alias("n_repeat_words"),
        F.when(F.size("grams") > 0, F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get("weights", g)) / F.size("grams")).otherwise(F.lit(0.0)).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = _worked_out_once(~failed & (F.col("score") >= threshold))
    return counted.withColumn("base_failed", failed).withColumn("kept", kept)


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts and verdict for every document.

    Returns one row per input row: doc_id, n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_dup_lines
    (lines with a word, equal to an earlier one), n_repeat_words (words in 5-word windows found twice or more in the text),
    score, base_failed (under 10 words, or over 20 % repeated), kept (not base_failed, and score >= ``threshold``).

    ``labels`` has the id column, quality and toxic; rows of quality 1 that are not toxic are trusted. Without such rows all
    weights follow the corpus alone and the threshold still holds. Null and empty texts count nothing, score 0 and fail for
    their length. Repeated rows are judged alike and count in the corpus each time. Other columns are ignored; an empty table gives no rows.
    """
    judged = _judged(df, labels, id_col, text_col, threshold)
    return judged.select(F.col("row")[id_col].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def filter_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, unchanged, that ``quality_rules`` keeps."""
    return _judged(df, labels, id_col, text_col, threshold).filter("kept").select("row.*")
