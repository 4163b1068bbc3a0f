"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, language_model, licenses, near_dedup, quality, quality_rules, secrets, spelling, substring_dedup, url_filter, vector_codes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    back = bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return found.select(
        "doc_id",
        *(secrets.count(F.col("base"), k).alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
        "live",
        "copied",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    labels = lambda *cs: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda d: d["label"]) for c in cs)))), ",")
    doubt = F.aggregate(F.concat("base", "detections"), F.lit(1.0), lambda x, d: x * (1 - d["sure"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "detections").alias("labels"),
        (1 - doubt).alias("score"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.cleaned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), slip=31)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), host=F.col("source"), carried=F.col("doc_id"))
    return found.select(
        F.col("own").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "depleted"
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_byte_bpe, op2_near_dedup, op3_decontaminate, op4_quality, op5_secrets, op6_exact_dedup, op7_language_model, op8_licenses, op9_substring_dedup, op10_url_filter)
    every += (op11_spelling, op12_quality_rules, op13_vector_codes)
    return {f.__name__: f for f in every}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_PLAIN = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format(_FOLDED)} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN.format(_FOLDED)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, CAST(least(len(w), 10) AS BIGINT) AS k, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS x
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS x
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM grams g JOIN win ON win.k = g.k AND win.x = g.x),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM g JOIN (SELECT x FROM g GROUP BY x HAVING count(*) > 1) USING (x)),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r)),
k AS (SELECT d.doc_id, d.w, coalesce(h.h, []) AS h FROM d LEFT JOIN (SELECT doc_id, list(p) AS h FROM c GROUP BY doc_id) h ON h.doc_id = d.doc_id),
u AS (SELECT k.doc_id, string_agg(k.w[u.i], ' ' ORDER BY u.i) AS kept FROM k, LATERAL (SELECT unnest(range(1, len(k.w) + 1)) AS i) u LEFT JOIN c ON c.doc_id = k.doc_id AND c.p = u.i WHERE c.p IS NULL GROUP BY k.doc_id)
SELECT k.doc_id, CAST(len(k.w) AS BIGINT) AS n_words, CAST(len(k.h) AS BIGINT) AS n_removed, sha256(coalesce(u.kept, '')) AS kept_sha256
FROM k LEFT JOIN u ON u.doc_id = k.doc_id
"""

_LINE = r"array_to_string(list_filter(regexp_split_to_array(translate({}, '{}', '{}'), '[\x20\x09-\x0D]+'), lambda w: w <> ''), ' ')".format(
    "line", _UPPER + "123456789", _LOWER + "0" * 9
)

RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, {_WORDS.format("t")} AS w FROM d),
g AS (SELECT r, i, w[i:i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1) GROUP BY r),
l AS (SELECT r, source, t, line, {_LINE} AS x FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
full_lines AS (SELECT * FROM l WHERE x <> ''),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
often AS (SELECT f.source, x FROM full_lines f JOIN hosts h ON h.source IS NOT DISTINCT FROM f.source GROUP BY f.source, x, h.n HAVING count(DISTINCT t) > 10 AND 100 * count(DISTINCT t) > h.n),
gone AS (SELECT r, sum(len(string_split(f.x, ' '))) AS n FROM full_lines f JOIN often o ON o.x = f.x AND o.source IS NOT DISTINCT FROM f.source GROUP BY r),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN again USING (r) LEFT JOIN dups USING (r) LEFT JOIN gone USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * (n_words - n_removed_words) < 50 * n_words AS depleted FROM s)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM j
"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds, one after the other."""
    found = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, k, x[k * (len(x) // {parts}) + 1 : (k + 1) * (len(x) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS k)),
c0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < {entries})"""
    nearest = "SELECT vec_id, p.k, p.x, min({{'d': list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.e}}) AS a FROM p JOIN c{} c ON c.k = p.k GROUP BY vec_id, p.k, p.x"
    for n in range(rounds):
        found += f""",
a{n} AS MATERIALIZED ({nearest.format(n)}),
m{n} AS (SELECT k, e, list(m ORDER BY i) AS x FROM (SELECT k, a.e AS e, i, CAST(floor(sum(y)::HUGEINT::DOUBLE / count(*)) AS BIGINT) AS m
  FROM (SELECT k, a, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{n}) GROUP BY k, e, i) GROUP BY k, e),
c{n + 1} AS MATERIALIZED (SELECT c.k, c.e, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.k = c.k AND m.e = c.e)"""
    return f"""{found},
z AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', a.e), '' ORDER BY k) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM ({nearest.format(rounds)}) GROUP BY vec_id)
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) FROM c{rounds}) AS codebooks_sha256
FROM v JOIN z USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": NEAR_SQL, "op3_decontaminate": DECONTAMINATE_SQL, "op6_exact_dedup": EXACT_SQL, "op9_substring_dedup": SUBSTRING_SQL, "op12_quality_rules": RULES_SQL, "op13_vector_codes": _codes_sql()}
