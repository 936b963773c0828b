"""Recurring lines by a log-template tree, in DataFrame operations.

A line is parsed into tokens; tokens with a digit are variable fields from the start. The tree has a fixed depth: a
line goes to the leaf named by its token count and its first DEPTH tokens. Two kinds of template come out of it. A whole
line, with its fields, is one. A leaf's lines also generalise: positions on which nearly all of them agree are constant,
the rest become fields, and if enough is constant, the lines that agree on all of it share a template.

A template is dropped where it recurs across documents. Copies of a document bring all their lines along with their
surroundings; furniture stands among different lines each time. Exact copies count as one text. A template recurs if it is
found in MIN_DOCUMENTS texts with as many different surroundings, however many copies hold it: the leading tokens of the nearest lines before and after it
that are not themselves in as many texts, or, for texts that are copies, the rarest of those lines. A text is a copy if such lines make up
half of it and less than a fifth is its own: lines whose first and last tokens are those of no line of the other texts with
its rarest line. An edited line keeps one end or the other, so near copies have little of their own; texts that share nothing but a notice, however long beside
the rest, have all of the rest. Copies are left whole for deduplication by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire.llm.scratch import stage

SPACES = r"[\x20\x09\x0B-\x0D]+"
#: A token with a digit, seen from its start: what precedes the digit is never tried twice.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*"
#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Lines of fewer tokens say less, and need SHORT_FACTOR times the documents.
MIN_TOKENS = 4
SHORT_FACTOR = 2
MIN_DOCUMENTS = 10
#: Share of a text's tokens in recurring lines from which it may be a copy, and share of its own from which it is none: near duplicates have 0.8 in common.
COPIED = 0.5
OWN = 0.2
#: Share of a leaf's lines that agree on a constant position, and share of positions after DEPTH that are constant.
AGREEMENT = 0.8
CONSTANT = 0.6


def _normal(text: Column) -> Column:
    """Fields masked, one space between tokens, none at the ends of lines. Texts that need neither are passed as they are."""
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, FIELD, "<*>")).otherwise(text)
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for spaces in ("  ", "\t", "\r", "\x0b", "\x0c", "\n ", " \n"):
        odd = odd | F.contains(text, F.lit(spaces))
    return F.when(odd, F.regexp_replace(F.regexp_replace(masked, SPACES, " "), "(?md)^ | $", "")).otherwise(masked)


def _parsed(texts: DataFrame, with_line: bool = False) -> DataFrame:
    """(doc_id, text_hash, width, line_no, n_tokens, lead, tail, leaf, template) of every line of (doc_id, text), and the line; width is the text's number of tokens."""
    lines = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split(_normal(F.col("text")), "\n").alias("lines"), F.split("text", "\n").alias("given"))

    def place(line: Column, given: Column) -> Column:
        # a line of nothing but fields has no constant part; it is compared as it is given
        only_fields = F.startswith(line, F.lit("<*>")) & (F.trim(F.replace(line, F.lit("<*>"), F.lit(""))) == "")
        line = F.when(only_fields, F.trim(F.regexp_replace(given, SPACES, " "))).otherwise(line)
        n = F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
        return F.struct(n.alias("n_tokens"), F.xxhash64(F.substring_index(line, " ", DEPTH)).alias("lead"), F.xxhash64(F.substring_index(line, " ", -DEPTH)).alias("tail"), F.xxhash64(line).alias("template"), *([line.alias("line")] if with_line else []))

    placed = lines.select("doc_id", "text_hash", F.zip_with("lines", "given", place).alias("places"))

    def row(x: Column, i: Column) -> Column:
        own = [x["line"].alias("line")] if with_line else []
        return F.struct(i.alias("line_no"), x["n_tokens"].alias("n_tokens"), x["lead"].alias("lead"), x["tail"].alias("tail"), F.xxhash64(x["n_tokens"], x["lead"]).alias("leaf"), x["template"].alias("template"), *own)

    width = F.aggregate("places", F.lit(0), lambda n, x: n + x["n_tokens"]).alias("width")
    return placed.select("doc_id", "text_hash", width, F.explode(F.filter(F.transform("places", row), lambda x: x["n_tokens"] > 0)).alias("x")).select("doc_id", "text_hash", "width", "x.*")


def _in_texts(lines: DataFrame, key: str, min_documents: int) -> DataFrame:
    """(key, documents) of the values of ``key`` that are found in enough different texts."""
    return lines.select(key, "text_hash").distinct().groupBy(key).agg(F.count("*").alias("documents")).filter(F.col("documents") >= min_documents)


def _in_context(lines: DataFrame, templates: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines whose template or leaf is in many texts, with ``documents`` of the template and the leading tokens of the nearest other lines as ``context``."""
    marked = lines.join(templates, "template", "left").join(leaves.withColumn("often", F.lit(True)), "leaf", "left")
    many = F.col("documents").isNotNull() | F.col("often").isNotNull()
    text, other = Window.partitionBy("doc_id", "text_hash"), F.last(F.when(~many, F.col("lead")), ignorenulls=True)
    earlier = (Window.unboundedPreceding, -1)
    sides = marked.withColumn("before", other.over(text.orderBy("line_no").rowsBetween(*earlier))).withColumn("after", other.over(text.orderBy(F.desc("line_no")).rowsBetween(*earlier)))
    return sides.filter(many).withColumn("context", F.xxhash64("before", F.lit(0), "after")).drop("before", "after", "often")


def _candidates(found: DataFrame) -> DataFrame:
    """(text_hash, source, width, n) of texts that may be copies: the rarest of their lines whose templates are in many texts, and the tokens of those lines."""
    lines = found.filter("documents is not null").groupBy("text_hash", "line_no").agg(F.first("n_tokens").alias("n_tokens"), F.first("width").alias("width"), F.first("template").alias("template"), F.first("documents").alias("documents"))
    texts = lines.groupBy("text_hash").agg(F.sum("n_tokens").alias("n"), F.first("width").alias("width"), F.min(F.struct("documents", "template"))["template"].alias("source"))
    return texts.filter(F.col("n") >= F.col("width") * COPIED).select("text_hash", "source", "width", "n")


def _sources(lines: DataFrame, templates: DataFrame, found: DataFrame, candidates: DataFrame) -> DataFrame:
    """(text_hash, source) of the candidates that have too little of their own to be anything but copies."""
    ends = F.explode(F.array(F.xxhash64(F.lit(0), "lead"), F.xxhash64(F.lit(1), "tail"))).alias("end")
    rest = lines.join(candidates.filter("n < width").select("text_hash", "source"), "text_hash").join(templates, "template", "left_anti")
    rest = stage(rest.select("source", "text_hash", "line_no", "n_tokens", ends).distinct())
    whole = found.filter("documents is not null").join(candidates.select("text_hash", "source"), "text_hash").select("source", "lead", "tail").distinct().select("source", ends)
    seen = rest.select("source", "end", "text_hash").distinct().select("source", "end", F.lit(1).alias("texts")).unionByName(whole.withColumn("texts", F.lit(2)))
    shared = seen.groupBy("source", "end").agg(F.sum("texts").alias("texts")).filter("texts > 1")
    by_line = rest.join(shared, ["source", "end"], "left").groupBy("text_hash", "line_no").agg(F.first("n_tokens").alias("n_tokens"), F.max("texts").alias("texts"))
    own = by_line.filter("texts is null").groupBy("text_hash").agg(F.sum("n_tokens").alias("own"))
    return candidates.join(own, "text_hash", "left").filter(F.coalesce("own", F.lit(0)) < F.col("width") * OWN).select("text_hash", "source")


def _recurring(lines: DataFrame, key: str, sources: DataFrame, min_documents: int) -> DataFrame:
    """The values of ``key`` that recur in different surroundings."""
    by_text = lines.groupBy(key, "text_hash").agg(F.min("context").alias("context"), F.first("n_tokens").alias("n_tokens")).join(sources, "text_hash", "left")
    around = by_text.groupBy(key, F.coalesce("source", "context").alias("around")).agg(F.first("n_tokens").alias("n_tokens"))
    asked = F.when(F.col("n_tokens") < MIN_TOKENS, SHORT_FACTOR * min_documents).otherwise(min_documents)
    return around.groupBy(key).agg(F.count("*").alias("n"), F.first("n_tokens").alias("n_tokens")).filter(F.col("n") >= asked).select(key)


def _generalised(texts: DataFrame, leaves: DataFrame, found: DataFrame, sources: DataFrame, min_documents: int) -> DataFrame:
    """(doc_id, text_hash, line_no) of lines whose leaf generalises to a recurring template."""
    lines = stage(_parsed(texts, with_line=True).join(leaves, "leaf").select("doc_id", "text_hash", "line_no", "leaf", F.split("line", " ").alias("tokens")))
    each = lines.dropDuplicates(["text_hash", "line_no"])  # exact copies have one say
    cells = each.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("n"))
    modes = cells.groupBy("leaf", "at").agg(F.max_by("token", F.struct("n", "token")).alias("token"), F.max("n").alias("n"), F.sum("n").alias("total"))
    constant = F.col("n") >= F.col("total") * AGREEMENT
    shape = F.array_sort(F.collect_list(F.struct("at", F.when(constant, F.col("token")).alias("token"))))
    templates = modes.groupBy("leaf").agg(shape.alias("shape"), F.count("*").alias("width"), F.sum((constant & (F.col("at") >= DEPTH)).cast("int")).alias("fixed"))
    templates = stage(templates.filter(F.col("fixed") >= (F.col("width") - DEPTH) * CONSTANT))
    follows = F.forall(F.zip_with("tokens", "shape", lambda t, s: s["token"].isNull() | (t == s["token"])), lambda x: x)
    members = lines.join(templates, "leaf").filter(follows).select("doc_id", "text_hash", "line_no", "leaf")
    contexts = found.join(leaves, "leaf", "left_semi").select("text_hash", "line_no", "n_tokens", "context").distinct()
    return members.join(_recurring(members.join(contexts, ["text_hash", "line_no"]), "leaf", sources, min_documents), "leaf").select("doc_id", "text_hash", "line_no")


def _masks(dropped: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_gone, gone): the line numbers of each text as bits, 64 lines to a number."""
    lines = dropped.distinct()
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("line_no", F.lit(64)))
    blocks = lines.groupBy("doc_id", "text_hash", F.floor(F.col("line_no") / 64).cast("int").alias("block")).agg(F.bit_or(bit).alias("mask"), F.count("*").alias("n"))
    texts = blocks.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_gone"), F.max("block").alias("last"), F.map_from_entries(F.collect_list(F.struct("block", "mask"))).alias("masks"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.element_at("masks", k), F.lit(0).cast("long")))
    return texts.select("doc_id", "text_hash", "n_gone", dense.alias("gone"))


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, dropped_col: str | None = None) -> DataFrame:
    """All rows and columns of ``df``, with lines of recurring templates taken out of ``text_col``.

    With ``dropped_col``, a new name, that column of the result says how many lines went. Lines end at \\n and those that stay are
    joined by it again; a text that loses all its lines is empty. Null texts stay null. Rows that repeat an id are told apart
    by their texts; equal rows count as one document. A null id is an id like any other. An empty table gives no rows.
    """
    if dropped_col in df.columns:
        raise ValueError(f"{dropped_col} is a column already")
    key = F.col(id_col).alias("doc_id")
    texts = df.filter(F.col(text_col).isNotNull()).select(key, F.col(text_col).cast("string").alias("text"))
    keyed = stage(_parsed(texts))
    templates = stage(_in_texts(keyed, "template", min_documents))
    often = stage(_in_texts(keyed.filter(F.col("n_tokens") >= 2 * DEPTH), "leaf", min_documents).select("leaf"))
    found = stage(_in_context(keyed, templates, often))
    sources = stage(_sources(keyed, templates, found, stage(_candidates(found))))
    whole = stage(_recurring(found.filter("documents is not null"), "template", sources, min_documents))
    dropped = found.join(whole, "template", "left_semi").select("doc_id", "text_hash", "line_no")
    rest = found.join(whole, "template", "left_anti").filter(F.col("n_tokens") >= 2 * DEPTH)
    leaves = stage(_recurring(rest, "leaf", sources, min_documents))
    dropped = dropped.unionByName(_generalised(texts, leaves, found, sources, min_documents))
    by_document = _masks(dropped)

    given = df.select(F.struct(*df.columns).alias("row"), key, F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")).alias("g")
    g = given.join(by_document.alias("b"), F.col("g.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("g.text_hash") == F.col("b.text_hash")), "left")
    text = F.col("row")[text_col].cast("string")

    def stays(_: Column, i: Column) -> Column:
        mask = F.coalesce(F.get("gone", F.floor(i / 64).cast("int")), F.lit(0))
        return F.call_function("shiftrightunsigned", mask, F.pmod(i, F.lit(64))).bitwiseAND(F.lit(1)) == 0

    kept = F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
    columns = [F.when(F.col("gone").isNull() | text.isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]
    if dropped_col:
        columns.append(F.coalesce("n_gone", F.lit(0)).cast("long").alias(dropped_col))
    return g.select(*columns)
