"""The operators over the driver's tables, one registered query each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire.llm import bpe, chat, codes, embeddings, licenses, linedup, minhash, mixing, quality, secrets, spelling, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["length"].cast("string"), m["learn"].cast("string"))), ",")
    return rotated.select("conv_id", "speaker", "n_turns", "n_own_turns", "rendered", mask.alias("mask"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def token_digests(documents: DataFrame) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to, of every document."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(documents.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_text=False)
    decoded = bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = _table(spark, sf_dir, "documents")
    words = secrets.COMMON_WORDS, secrets.vocabulary_words(public_tokenizers.path("byte_bpe_50k.tiktoken")), secrets.corpus_words(documents)
    found = secrets.scan_secrets(documents, words=words)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_guess", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linedup.drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), dropped_col="n_dropped")
    return left.select("doc_id", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.char_length("text").cast("long").alias("n_chars_left"))


def op9_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    domains = list(mixing.TARGETS)
    scored = mixing.score_documents(_table(spark, sf_dir, "documents"), labels, domains, ["doc_id"])
    only_clean, blend = mixing.fit_rates(scored, [[weights[d] for d in domains] for weights in (mixing.TARGETS, mixing.BLEND)], domains.index("clean"))
    rates = mixing.with_rates(scored, {"rate": only_clean, "blend_rate": blend})
    shares = [F.round(F.get("posterior", F.lit(i)), 6).alias(f"p_{domain}") for i, domain in enumerate(domains)]
    doc_id = F.col("row.doc_id")
    return rates.select(
        doc_id.alias("doc_id"), "n_tokens", *shares, mixing.likeliest(domains).alias("domain"), F.round("rate", 6).alias("rate"), mixing.copies(F.col("rate"), doc_id).alias("copies"),
        F.round("blend_rate", 6).alias("blend_rate"), mixing.copies(F.col("blend_rate"), doc_id).alias("blend_copies"), F.lit(round(blend.gap, 6)).alias("blend_gap"), F.lit(blend.converged).alias("blend_converged"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated_windows(_table(spark, sf_dir, "documents"), window=50)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(documents, lexicon, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_matches", "score")
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_words", "n_matches")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), every=97)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = codes.compress(_table(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    entries = ",".join(map(str, codebooks.reshape(-1).tolist()))
    digest = F.sha2(F.lit(entries).cast("binary"), 256).alias("codebooks_sha256")
    return codes.with_group_error(coded, "label").select(F.col("row.vec_id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", F.col("group_error").alias("label_error"), digest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_chat_perspectives": op3_chat_perspectives,
        "op4_quality_rules": op4_quality_rules,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_secret_scan": op7_secret_scan,
        "op8_line_dedup": op8_line_dedup,
        "op9_mixing_rates": op9_mixing_rates,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_toxicity": op11_toxicity,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_vector_codes": op13_vector_codes,
    }


OP3_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said),
parts AS (
  SELECT s.conv_id, p.speaker, s.turn, s.role, s.text, s.role = p.speaker AS own,
         CASE WHEN s.role = p.speaker THEN '<|assistant|>' ELSE '<|user name=' || replace(replace(replace(s.role, '\', '\\'), '<|', '<\|'), '|>', '|\>') || CASE WHEN s.role LIKE '%<' THEN '\' ELSE '' END || '|>' END || chr(10) AS header,
         replace(replace(s.text, '<\', '<\\'), '<|', '<\|') || '<|end|>' || chr(10) AS body
  FROM said s JOIN speakers p USING (conv_id)
)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own_turns,
       string_agg(header || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       string_agg(length(header) || ':0,' || length(body) || ':' || CAST(own AS INTEGER), ',' ORDER BY turn NULLS FIRST, role, text) AS mask
FROM parts GROUP BY conv_id, speaker
"""


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_COMPONENTS = """links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT node, node AS origin FROM nodes UNION SELECT l.b, r.origin FROM reached r JOIN links l ON r.node = l.a)"""

OP1_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingles AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS node FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(origin) AS component_id FROM reached GROUP BY node) USING (doc_id)
"""

OP6_SQL = f"""
WITH RECURSIVE pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.98
), nodes AS (SELECT vec_id AS node FROM embeddings), {_COMPONENTS}
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN (SELECT node AS vec_id, min(origin) AS component_id FROM reached GROUP BY node) USING (vec_id)
"""

OP10_SQL = f"""
WITH words AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
owners AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM windows JOIN owners USING (k) WHERE owner < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""


def _op2_sql() -> str:
    letters = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    templates = ", ".join(f"({i}, '{label}', '{text.lower()}')" for i, (label, text) in enumerate(licenses.TEMPLATES))
    places = {label: " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split())) for label, phrase in licenses.PHRASES.items()}
    starts = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: coalesce({where}, false)) AS {label}" for label, where in places.items())
    base = ", ".join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for label in sorted(places))
    every = " || ".join(places)
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {letters}) AS w FROM documents),
templates AS (SELECT id, label, regexp_extract_all(text, {letters}) AS w FROM (VALUES {templates}) t(id, label, text)),
runs AS (SELECT id, label, len(w) - 2 AS n, i - 1 AS tpos, array_to_string(w[i:i + 2], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM templates)),
votes AS (SELECT doc_id, id, label, n, i - 1 AS place, tpos FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM words)) JOIN runs USING (run)),
steps AS (SELECT *, CASE WHEN place - tpos - lag(place - tpos) OVER (PARTITION BY doc_id, id ORDER BY place - tpos, place) <= {licenses.SLACK} THEN 0 ELSE 1 END AS apart FROM votes),
spans AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, id ORDER BY place - tpos, place) AS span FROM steps),
verified AS (SELECT doc_id, label, count(DISTINCT tpos) / any_value(n) AS coverage FROM spans GROUP BY doc_id, id, label, span HAVING count(DISTINCT tpos) / any_value(n) >= {licenses.COVERAGE}),
more AS (SELECT doc_id, list_sort(list_distinct(list(label))) AS more, max(coverage) AS coverage FROM verified GROUP BY doc_id),
base AS (SELECT *, {every} AS every, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM (SELECT doc_id, w, {starts} FROM words))
SELECT doc_id, len(w) AS n_words, len(every) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels, CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(coverage, 0.0) END AS score
FROM base LEFT JOIN more USING (doc_id)
"""


def _op12_sql() -> str:
    table = []
    for n in range(256):  # the table of the usual reflected polynomial
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    low = spelling.RUNS.replace(r"\u00C0", "\u00c0").replace(r"\u00FF", "\u00ff")
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{low}')) AS run FROM documents) GROUP BY ALL),
named AS (SELECT run, k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name FROM runs),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(name, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))),
    lambda crc, b: xor(CAST({table} AS BIGINT[])[(xor(crc, b) & 255) + 1], crc >> 8))) AS h FROM named),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
skips AS (SELECT word, n, substr(word, 1, i) AS before, substr(word, i + 2) AS after FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT s.word AS a, v.word AS b FROM skips s JOIN words v ON s.before || s.after = v.word),
pairs AS (SELECT x.word AS a, y.word AS b FROM skips x JOIN skips y USING (before, after) WHERE x.word <> y.word UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter),
near AS (SELECT a AS word, count(*) AS n_near FROM pairs GROUP BY a),
best AS (SELECT a AS word, b AS form, n AS form_n FROM (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pairs JOIN words ON b = words.word) WHERE r = 1),
forms AS (SELECT word, form, form_n FROM best JOIN words USING (word) WHERE form_n >= 2 * n),
walk AS (SELECT word, word AS reached FROM words UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON w.reached = f.word),
ends AS (SELECT walk.word, reached AS root FROM walk LEFT JOIN forms ON reached = forms.word WHERE forms.word IS NULL)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN near USING (word) LEFT JOIN forms USING (word) JOIN ends USING (word)
"""


def _op13_sql() -> str:
    parts, entries = codes.PARTS, codes.ENTRIES
    squares = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    rounds = ""
    for r in range(codes.ROUNDS + 1):
        rounds += f""",
a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min([d, e]) AS de FROM (SELECT vec_id, p, e, x, {squares} AS d FROM parts JOIN c{r} USING (p)) GROUP BY vec_id, p)"""
        if r < codes.ROUNDS:
            rounds += f""",
m{r} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, de[2] AS e, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, e))"""
    last = codes.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM (SELECT *, unnest(range({parts})) AS p FROM kept)),
c0 AS MATERIALIZED (SELECT p, e, c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts) WHERE e < {entries}){rounds},
coded AS (SELECT vec_id, string_agg(printf('%02x', de[2]), '' ORDER BY p) AS code, CAST(sum(de[1]) AS BIGINT) AS error FROM a{last} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express: op4 and op8 hash with a function that DuckDB lacks, op5, op7, op9 and op11 are no SQL."""
    return {
        "op1_minhash_near_dedup": OP1_SQL,
        "op2_license_scan": _op2_sql(),
        "op3_chat_perspectives": OP3_SQL,
        "op6_embedding_near_dedup": OP6_SQL,
        "op10_substring_dedup": OP10_SQL,
        "op12_spelling_variants": _op12_sql(),
        "op13_vector_codes": _op13_sql(),
    }
