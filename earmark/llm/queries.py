"""Queries over the given tables, one for each operator; those that SQL can express carry their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.llm import codes, decontaminate, exact, langid, lines, lm, mixing, packing, secret_scan, simhash, spelling, toxicity, wrappers
from earmark.llm.common import LOWER, UPPER, remainder

SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _part(modulus: int, value: int):
    """Whether the id's remainder is ``value``; a null id's isn't."""
    return F.coalesce(remainder(F.col("doc_id"), modulus) == value, F.lit(False))


@query()
def op1_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Each document that holds a benchmark item, with the item and what of it overlaps."""
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).withColumnRenamed("id", "doc_id")


@query()
def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document, by a model of the documents that aren't held out, and a baseline."""
    docs = _table(spark, folder, "documents")
    model = lm.train(docs.filter(F.col("doc_id").isNotNull() & ~_part(7, 2)))
    scored = lm.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", _part(7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


@query()
def op3_packed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as packed rows of token ids."""
    return packing.pack(_table(spark, folder, "documents"))


@query()
def op4_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    groups = simhash.near_duplicates(_table(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    texts = wrappers.extract(_table(spark, folder, "pages"))
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes, and the shards its copies go to."""
    plan = mixing.mix(_table(spark, folder, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")


@query()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, folder, "documents")
    model = langid.fit(docs.filter(F.col("doc_id").isNotNull() & ~_part(4, 2)), "text", "lang")
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", _part(4, 2).alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"))


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, and where its toxic words stand."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.filter(F.col("doc_id").isNotNull() & ~_part(5, 0)))
    found = toxicity.toxic_spans(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", _part(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@query(f"""
WITH line AS (
  SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
kept AS (
  SELECT doc_id, i, trim(string_split(coalesce(text, ''), chr(10))[i], ' ' || chr(9) || chr(13)) AS body FROM line),
numbered AS (SELECT doc_id, i, body, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM kept WHERE body <> ''),
counted AS (SELECT *, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS w FROM numbered),
runs AS (
  SELECT doc_id, p, {lines.RUN} AS n, body || chr(10) || b2 || chr(10) || b3 AS run FROM (
    SELECT *, lead(body, 1) OVER w AS b2, lead(body, 2) OVER w AS b3 FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY p)) WHERE b3 IS NOT NULL
  UNION ALL
  SELECT doc_id, p, 1, body FROM counted WHERE w >= {lines.LONG}
  UNION ALL
  SELECT doc_id, p, 2, body || chr(10) || b2 FROM (
    SELECT *, lead(body) OVER o AS b2, lead(w) OVER o AS w2 FROM counted WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE w + w2 >= {lines.LONG}),
later AS (SELECT doc_id, p, n FROM runs QUALIFY row_number() OVER (PARTITION BY n, run ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS p FROM later),
marked AS (SELECT n.doc_id, n.i, g.p IS NOT NULL AS removed FROM numbered n LEFT JOIN gone g USING (doc_id, p)),
lines AS (
  SELECT k.doc_id, k.i, string_split(coalesce(d.text, ''), chr(10))[k.i] AS line, m.i IS NOT NULL AS counts, coalesce(m.removed, false) AS removed
  FROM kept k JOIN documents d USING (doc_id) LEFT JOIN marked m USING (doc_id, i))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '') END AS text,
  count(*) FILTER (counts) AS n_lines, count(*) FILTER (removed) AS n_removed
FROM lines l JOIN documents d USING (doc_id) GROUP BY d.doc_id, d.text""")
def op9_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the runs of lines that stand earlier already."""
    out = lines.remove_repeats(_table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "text", "n_lines", "n_removed")


@query(f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op10_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Group of equal texts of every document. Half of the documents, by the id's checksum, are the history that is hashed."""
    docs = _table(spark, folder, "documents")
    groups = exact.exact_groups(docs.filter(_part(2, 0)), docs.filter(~_part(2, 0)))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _codes_sql() -> str:
    """Rounds of assignment and update, unrolled."""
    steps = [f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM documents_of_vectors
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (
  SELECT vec_id, label, p, list_slice(v, p * len(v) // {codes.PARTS} + 1, (p + 1) * len(v) // {codes.PARTS}) AS x
  FROM whole, (SELECT unnest(range({codes.PARTS})) AS p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM whole QUALIFY k < {codes.ENTRIES}),
book0 AS (SELECT p, k, x AS c FROM part JOIN first USING (vec_id))"""]
    apart = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    for r in range(codes.ROUNDS + 1):
        steps.append(f"""
near{r} AS (
  SELECT vec_id, label, p, x, k, d FROM (SELECT part.*, k, {apart} AS d FROM part JOIN book{r} USING (p))
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)""")
        if r < codes.ROUNDS:
            steps.append(f"""
item{r} AS (SELECT p, k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM near{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM part) + 1)) AS i) GROUP BY p, k, i),
mean{r} AS (SELECT p, k, list(m ORDER BY i) AS m FROM item{r} GROUP BY p, k),
book{r + 1} AS (SELECT p, k, coalesce(m, c) AS c FROM book{r} LEFT JOIN mean{r} USING (p, k))""")
    last = codes.ROUNDS
    steps.append(f"""
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books""")
    return ",".join(steps).replace("documents_of_vectors", "embeddings")


@query(_codes_sql())
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector, by codebooks of its parts."""
    coded, books = codes.compress(_table(spark, folder, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def _secrets_sql() -> str:
    """Each rule over all texts, without an index."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    each = [f"""
  SELECT doc_id, {place} AS place, {quoted(rule.kind)} AS kind, {rule.least} AS least, string_split_regex(t, {quoted(rule.pattern)}) AS gaps,
    regexp_extract_all(t, {quoted(rule.pattern)}, 0) AS found, regexp_extract_all(t, {quoted(rule.pattern)}, {rule.group}) AS part FROM texts""" for place, rule in enumerate(secret_scan.RULES)]
    base = len(secret_scan.BASE)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ruled AS ({" UNION ALL".join(each)}),
matched AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM ruled),
placed AS (
  SELECT doc_id, place, kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS first,
    length(found[i]) AS size FROM matched WHERE length(part[i]) >= least),
joined AS (SELECT doc_id, place, first, kind || ':' || first || ':' || (first + size) AS span FROM placed)
SELECT d.doc_id, count(span) FILTER (place = 0) AS n_assign, count(span) FILTER (place = 1) AS n_access, count(span) FILTER (place = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY first, place) FILTER (place < {base}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY first, place), '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id) GROUP BY d.doc_id"""


def _of_rule(place: int):
    return lambda span: span["place"] == place


@query(_secrets_sql())
def op12_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, by kind and place."""
    found = secret_scan.scan(_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["place"] < len(secret_scan.BASE))
    counts = [F.size(F.filter("spans", _of_rule(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE)]
    digest = F.sha2(secret_scan.spans_text(base).cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), *counts, digest.alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"))


@query(f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY doc_id, run),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM runs),
drawn AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM bytes, crc),
slipped AS (
  SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM drawn),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
cuts AS (SELECT word, i, substring(word, 1, i - 1) || '_' || substring(word, i + 1) AS cut FROM words, (SELECT unnest(range(1, (SELECT max(length(word)) FROM words) + 1)) AS i) WHERE i <= length(word)),
shorter AS (SELECT word, replace(cut, '_', '') AS rest FROM cuts),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
best AS (
  SELECT p.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS near, max(w.n) AS near_n FROM pairs p JOIN words w ON p.near = w.word GROUP BY p.word),
known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word))
SELECT word, n, n_near, form, form_n, root FROM known JOIN (
  WITH RECURSIVE path AS (SELECT word AS first, word AS last FROM known UNION SELECT first, form FROM path JOIN known ON last = known.word WHERE form IS NOT NULL)
  SELECT first AS word, last AS root FROM path JOIN known ON last = known.word WHERE form IS NULL) USING (word)""")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with its near words and the form that it is a variant of."""
    return spelling.variants(_table(spark, folder, "documents"))


@query()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
