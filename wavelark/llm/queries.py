"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavelark.llm import embedding_dedup, exact_dedup, license_scan, line_dedup, minhash, mixing, packing, substring_dedup, suffix_dedup, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir), keep="largest")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(_docs(spark, sf_dir))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), words=2, percent=80)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_report(_docs(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup_report(_docs(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_docs(spark, sf_dir)).drop("spans")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_best_fit_packing, op3_line_dedup, op4_minhash_dedup, op5_suffix_array_dedup, op6_substring_dedup, op7_toxicity, op8_mixing, op9_license_scan, op10_embedding_dedup)}


_OP1 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_OP3 = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, i - 1 AS no, parts[i] AS raw, regexp_replace(parts[i], '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM split) WHERE parts[i] <> ''),
toks AS (SELECT *, string_split(line, ' ') AS t FROM lines),
leafed AS (
  SELECT doc_id, no, concat('0 ', raw) AS leaf, raw AS line, true AS whole FROM toks
  UNION ALL
  SELECT doc_id, no, concat_ws(' ', k, len(t), CASE WHEN k < 3 THEN t[1] ELSE t[2] END, CASE WHEN k = 1 THEN t[2] ELSE t[3] END), line, false
  FROM (SELECT *, unnest([1, 2, 3]) AS k FROM toks WHERE len(t) > 1)),
chosen AS (SELECT DISTINCT doc_id, leaf, line FROM leafed WHERE NOT whole AND leaf IN (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10)),
tokens AS (
  SELECT doc_id, leaf, line, pos, string_split(line, ' ')[pos] AS token
  FROM (SELECT *, unnest(generate_series(1, len(string_split(line, ' ')))) AS pos FROM chosen)),
common AS (SELECT leaf, pos, token FROM tokens WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
templates AS (
  SELECT t.leaf, t.line, avg(CASE WHEN c.token IS NULL THEN 0 ELSE 1 END) AS share,
         string_agg(CASE WHEN c.token IS NULL THEN '<*>' ELSE t.token END, ' ' ORDER BY t.pos) AS template
  FROM (SELECT DISTINCT leaf, line, pos, token FROM tokens) t LEFT JOIN common c ON t.leaf = c.leaf AND t.pos = c.pos AND t.token = c.token GROUP BY t.leaf, t.line),
good AS (SELECT * FROM templates WHERE share >= 0.5),
often AS (
  SELECT g.leaf, g.template FROM good g JOIN chosen c ON g.leaf = c.leaf AND g.line = c.line GROUP BY ALL HAVING count(DISTINCT c.doc_id) >= 10),
gone AS (
  SELECT g.leaf, g.line FROM good g JOIN often o ON g.leaf = o.leaf AND g.template = o.template
  UNION ALL
  SELECT leaf, line FROM leafed WHERE whole GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
dropped AS (
  SELECT l.doc_id, list(DISTINCT l.no) AS nos FROM leafed l JOIN gone g ON l.leaf = g.leaf AND l.line = g.line GROUP BY l.doc_id)
SELECT s.doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(coalesce(len(nos), 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN nos IS NULL THEN text ELSE coalesce(array_to_string(list_filter(parts, lambda x, i: NOT list_contains(nos, i - 1)), chr(10)), '') END) AS kept_sha256
FROM split s LEFT JOIN dropped d ON s.doc_id = d.doc_id
"""

_COMPONENTS = """
reach(id, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
least AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
"""

_OP4 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT p.doc_id AS a, q.doc_id AS b, p.n AS na, q.n AS nb, count(*) AS same
  FROM shingles p JOIN shingles q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * same >= 80 * (na + nb - same)),
{_COMPONENTS}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least ON id = doc_id
"""

#: Runs of windows of 50 units that start in a document with a smaller id, as first and last + 1 unit.
_RUNS = """
first AS (SELECT win, min(doc_id) AS owner FROM windows GROUP BY win),
hits AS (SELECT w.doc_id, w.i FROM windows w JOIN first f ON f.win = w.win WHERE f.owner < w.doc_id),
apart AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hits),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM apart) GROUP BY doc_id, run)
"""

_OP5 = f"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
  SELECT doc_id, p * 400 AS base, substr(h, 800 * p + 1, 900) AS part
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 800 + 1)) AS p FROM raw)),
windows AS (
  SELECT doc_id, base + k AS i, substr(part, 2 * k + 1, 100) AS win
  FROM (SELECT doc_id, base, part, unnest(range(0, least(400, len(part) // 2 - 49))) AS k FROM pieces WHERE len(part) >= 100)),
{_RUNS},
gaps AS (
  SELECT r.doc_id, r.a, r.b, coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) AS from_, h FROM runs r JOIN raw ON raw.doc_id = r.doc_id),
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS kept FROM gaps GROUP BY doc_id)
SELECT raw.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM raw LEFT JOIN cut ON cut.doc_id = raw.doc_id
"""

_OP6 = rf"""
WITH raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM raw WHERE len(w) >= 50)),
{_RUNS},
placed AS (SELECT doc_id, w[i + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM raw)),
stay AS (
  SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.i) AS kept
  FROM placed p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = p.doc_id AND p.i >= r.a AND p.i < r.b) GROUP BY p.doc_id)
SELECT raw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM raw LEFT JOIN stay ON stay.doc_id = raw.doc_id
"""

_OP10 = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
sized AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size
  FROM vectors WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
units AS (SELECT vec_id, list_transform(e, lambda x: x / size) AS u FROM sized WHERE size > 0),
links AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM units p JOIN units q ON p.vec_id <> q.vec_id WHERE list_inner_product(p.u, q.u) >= CAST(0.95 AS DOUBLE)),
{_COMPONENTS},
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM vectors LEFT JOIN least ON id = vec_id LEFT JOIN counted ON a = vec_id
"""

_OP8 = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(text, ''))) AS place FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS q FROM base GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][CAST((q - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS cap FROM sources),
levels AS (
  SELECT *, least(sum(CAST(source_size AS DOUBLE)) OVER () * 1.5, sum(cap) OVER ()) AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY cap / weight, q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM weighed),
lowest AS (SELECT *, max(CASE WHEN cap > (budget - filled) / open * weight THEN (budget - filled) / open END) OVER () AS level FROM levels),
goals AS (
  SELECT source, q, source_size, CASE WHEN level IS NULL OR cap <= level * weight THEN cap ELSE level * weight END AS target FROM lowest),
placed AS (
  SELECT b.doc_id, b.size, b.place, g.q, g.source_size, g.target,
         sum(b.size) OVER (PARTITION BY g.q ORDER BY b.place) AS upto
  FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT doc_id, place, q, size, e, CAST(e * source_size + upto AS DOUBLE) / target AS finish
  FROM placed, (SELECT unnest([0, 1]) AS e) WHERE target > 0 AND size > 0),
summed AS (SELECT *, sum(size) OVER (ORDER BY finish, q, place, e) AS total FROM copies),
taken AS (
  SELECT place, CAST(count(DISTINCT e) AS BIGINT) AS n FROM summed WHERE total <= (SELECT sum(target) FROM goals) GROUP BY place)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(p.size * coalesce(t.n, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN taken t ON p.place = t.place
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op3_line_dedup": _OP3, "op4_minhash_dedup": _OP4, "op5_suffix_array_dedup": _OP5, "op6_substring_dedup": _OP6, "op8_mixing": _OP8, "op10_embedding_dedup": _OP10}
