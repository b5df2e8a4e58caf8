"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import codes, licenses, line_dedup, near_copies, outliers, packing, passages, pieces, pii, secrets, top_k, toxicity, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(run):
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op1_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.reject_outliers(_table(spark, sf_dir, "documents"))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@_query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


@_query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


@_query
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"))


SQL["op9_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: TRY_CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@_query
def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(_table(spark, sf_dir, "documents"))


@_query
def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@_query
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings")).drop("label")


def _codes_sql() -> str:
    """Two rounds over (vector, part, place, component) rows; the nearest entry is the least of (distance, entry)."""
    ctes = ["""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (SELECT r, unnest(x) AS val, unnest(range(len(x))) AS d, len(x) // 16 AS wide FROM v
), u AS MATERIALIZED (SELECT r, d // wide AS p, d % wide AS j, val FROM w
), b0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, val FROM u WHERE r <= 64)"""]
    near = lambda k: f"""n{k} AS MATERIALIZED (SELECT r, p, min(row(dist, e)) AS best FROM (
  SELECT u.r, u.p, b.e, sum((u.val - b.val) * (u.val - b.val)) AS dist FROM u JOIN b{k} b ON u.p = b.p AND u.j = b.j GROUP BY u.r, u.p, b.e) GROUP BY r, p)"""  # noqa: E731
    for k in range(2):
        ctes.append(near(k))
        ctes.append(f"""m{k} AS (SELECT u.p, n.e, u.j, sum(u.val) AS s, count(*) AS c FROM u JOIN (SELECT r, p, best[2] AS e FROM n{k}) n ON u.r = n.r AND u.p = n.p GROUP BY u.p, n.e, u.j
), b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(CAST((m.s - ((m.s % m.c) + m.c) % m.c) // m.c AS BIGINT), b.val) AS val FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e AND b.j = m.j)""")
    ctes.append(near(2))
    ctes.append("""c AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM n2 GROUP BY r
), h AS (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b2)""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (r) CROSS JOIN h"""


SQL["op12_codes"] = _codes_sql()


@_query
def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations")
    return turns.repair(given, turns.damage(given))
