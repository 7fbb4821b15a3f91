"""One query per operator over the driver's tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torqueline.llm import conversations, decontaminate, language_model, licenses, mixing, pii, quality, secrets, simhash, substrings, toxicity, warc
from torqueline.llm.base import REGISTRY, query, table

__all__ = ["REGISTRY", "conversations"]


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_columns(spans: Column, kinds: list[str]) -> list[Column]:
    """Counts of the base kinds, the hash of their spans, and all spans."""
    of = lambda *names: F.filter(spans, lambda s: s["kind"].isin(*names))
    return [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds] + [
        F.sha2(spelled(of(*kinds)), 256).alias("base_sha256"), spelled(spans).alias("spans")]


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CONTAMINATION_SQL = f"""
WITH i AS (SELECT item_id::VARCHAR AS item, {WORDS_SQL} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, unnest([array_to_string(w[x + 1:x + least(len(w), 10)], ' ')
                                FOR x IN range(len(w) - least(len(w), 10) + 1)]) AS win, least(len(w), 10) AS size
  FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, unnest(range(len(w) - size + 1)) AS p0,
         unnest([array_to_string(w[x + 1:x + size], ' ') FOR x IN range(len(w) - size + 1)]) AS win
  FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT doc_id, dw.size, p0, item FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + size)) AS p FROM hit) GROUP BY doc_id),
k AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""


@query("op1_decontamination", CONTAMINATION_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_TEMPLATES = ",\n         ".join(
    f"({t}, '{label}', {base}, {length}, {grams}, {place}, '{' '.join(gram)}')"
    for t, label, base, length, grams, place, gram in licenses.template_rows(licenses.BASE, licenses.NOTICES, 2))

LICENSES_SQL = f"""
WITH t(template, label, base, length, grams, place, gram) AS (VALUES {_TEMPLATES}),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(len(w) - 1)) AS p0, unnest([w[x + 1] || ' ' || w[x + 2] FOR x IN range(len(w) - 1)]) AS gram
  FROM d WHERE len(w) > 1),
v AS (
  SELECT doc_id, template, label, base, length, grams, p0 - place AS diagonal, list(place) AS places
  FROM g JOIN t USING (gram) GROUP BY ALL),
b AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > CASE WHEN base THEN 0 ELSE 2 END AS apart
  FROM v),
c AS (
  SELECT *, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band
  FROM b),
m AS (
  SELECT doc_id, template, band, any_value(label) AS label, any_value(base) AS base, min(diagonal) AS diagonal,
         max(len(places) / grams::DOUBLE) AS single,
         len(list_distinct(flatten(list(places)))) / max(grams)::DOUBLE AS everything,
         (max(diagonal + list_max(places)) + 2 - min(diagonal + list_min(places))) / max(length)::DOUBLE AS stretch
  FROM c GROUP BY doc_id, template, band),
o AS (
  SELECT *, CASE WHEN stretch <= 1.25 THEN greatest(single, everything) ELSE single END AS share FROM m
  WHERE CASE WHEN base THEN single = 1 ELSE single >= 0.8 OR (everything >= 0.8 AND stretch <= 1.25) END),
r AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(diagonal) FILTER (WHERE base) AS first_word,
         max(diagonal) FILTER (WHERE base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM o GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


@query("op3_license_scan", LICENSES_SQL)
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(len(w) - 4)) AS i,
         unnest([array_to_string(w[x + 1:x + 5], ' ') FOR x IN range(len(w) - 4)]) AS s FROM d WHERE len(w) > 5),
hot AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM hot WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS stutter,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS shout
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
f AS (
  SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.5 * len(l) OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR stutter > 0.3 * n_words OR shout > 0.4 * n_words) AS kept
FROM f
"""


@query("op8_quality_rules", QUALITY_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return quality.judge_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 10) | (100 * r > 20 * n)).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS symbols FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS total,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM d GROUP BY source),
c AS (
  SELECT *, 2 * total / weight::DOUBLE AS level, sum(2 * total) OVER w AS capped, sum(weight) OVER w AS used,
         sum(total) OVER () AS everything, sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY 2 * total / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
fill AS (
  SELECT max((3 * everything / 2 - (capped - 2 * total))::DOUBLE / (weights - (used - weight))::DOUBLE) AS share
  FROM c),
t AS (
  SELECT source, total, least(2.0 * total, weight * share) AS target FROM c, fill),
k AS (
  SELECT doc_id, size, d.source, total, target,
         CASE WHEN total = 0 THEN 0 ELSE least(2, floor(target / total)) END AS epochs,
         -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.1, 1.0 - least(1.0, symbols / greatest(size, 1)::DOUBLE)) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, size, total AS source_size, target::DOUBLE AS target,
       (size * epochs + CASE WHEN upto - size + size / 2.0 <= CASE WHEN epochs >= 2 THEN 0 ELSE target - epochs * total END
                             THEN size ELSE 0 END)::BIGINT AS taken
FROM r
"""


@query("op6_mixing", MIXING_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *base_columns(F.col("spans"), [r.kind for r in secrets.BASE]))


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *base_columns(F.col("spans"), list(pii.KINDS)))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_warc_derivatives")
def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = lambda name: F.element_at("headers", F.lit(name))
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"))).select(
        "page_id", head("WARC-Type").alias("record_type"), head("WARC-Record-ID").alias("record_id"),
        head("WARC-Refers-To").alias("refers_to"), head("WARC-Target-URI").alias("target_uri"),
        head("WARC-Source-Payload-Digest").alias("source_digest"), head("WARC-Block-Digest").alias("block_digest"),
        head("Content-Length").cast("long").alias("content_length"), "block")


@query("op11_language_model")
def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))
