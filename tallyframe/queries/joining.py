"""Merges, coverage, candidate joins and unions."""

from pyspark.sql import functions as F

from tallyframe.operators.fuzzy import blocked_pairs, fuzzy_join
from tallyframe.operators.joins import key_coverage, match_summary, merge
from tallyframe.operators.unions import union_all_columns, union_common, union_strict
from tallyframe.queries.registry import query

_KEYS = [{"left": "c_custkey", "right": "o_custkey"}]
_MERGE_SQL = """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, o_orderkey, o_custkey, o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority
       FROM customer {how} JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey"""


@query("merge_inner", _MERGE_SQL.format(how="INNER"))
def _(t):
    return merge(t.customer, t.orders, _KEYS, "inner")


@query("merge_left", _MERGE_SQL.format(how="LEFT"))
def _(t):
    return merge(t.customer, t.orders, _KEYS, "left")


@query("merge_right", _MERGE_SQL.format(how="RIGHT"))
def _(t):
    return merge(t.customer, t.orders, _KEYS, "right")


@query("merge_outer", _MERGE_SQL.format(how="FULL OUTER"))
def _(t):
    return merge(t.customer, t.orders, _KEYS, "outer")


@query(
    "merge_null_keys",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS nk, c_name AS name FROM customer),
            s AS (SELECT s_suppkey, CASE WHEN s_nationkey < 22 THEN s_nationkey END AS nk, s_name AS name FROM supplier)
       SELECT c_custkey, coalesce(c.nk, s.nk) AS nk, c.name AS name_left, s_suppkey, s.name AS name_right
       FROM c FULL OUTER JOIN s ON c.nk IS NOT DISTINCT FROM s.nk""",
)
def _(t):
    c = t.customer.select(
        "c_custkey", F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("nk"), F.col("c_name").alias("name")
    )
    s = t.supplier.select(
        "s_suppkey", F.when(F.col("s_nationkey") < 22, F.col("s_nationkey")).alias("nk"), F.col("s_name").alias("name")
    )
    return merge(c, s, [{"left": "nk", "right": "nk"}], "outer")


@query(
    "merge_two_keys",
    """SELECT e1.user_id, e1.event_id AS event_id_left, e1.kind, e2.event_id AS event_id_right, e2.event_type
       FROM (SELECT user_id, event_id, event_type AS kind FROM events) e1
       JOIN (SELECT user_id, event_id, event_type FROM events WHERE value > 200) e2
         ON e1.user_id IS NOT DISTINCT FROM e2.user_id AND e1.kind IS NOT DISTINCT FROM e2.event_type""",
)
def _(t):
    a = t.events.select("user_id", "event_id", F.col("event_type").alias("kind"))
    b = t.events.filter("value > 200").select("user_id", "event_id", "event_type")
    return merge(a, b, [{"left": "user_id", "right": "user_id"}, {"left": "kind", "right": "event_type"}], "inner")


@query(
    "merge_mixed_types",
    """SELECT c_custkey, c_name, key, o_totalprice FROM customer
       JOIN (SELECT CAST(o_custkey AS VARCHAR) AS key, o_totalprice FROM orders) ON CAST(c_custkey AS VARCHAR) = key""",
)
def _(t):
    orders = t.orders.select(F.col("o_custkey").cast("string").alias("key"), "o_totalprice")
    return merge(t.customer.select("c_custkey", "c_name"), orders, [{"left": "c_custkey", "right": "key"}], "inner")


@query(
    "merge_loose_keys",
    """SELECT c_custkey, key, o_totalprice FROM customer
       JOIN (SELECT '  ' || CAST(o_custkey AS VARCHAR) || '.00 ' AS key, o_totalprice FROM orders)
         ON c_custkey = CAST(TRY_CAST(trim(key) AS DOUBLE) AS BIGINT)""",
)
def _(t):
    orders = t.orders.select(
        F.concat(F.lit("  "), F.col("o_custkey").cast("string"), F.lit(".00 ")).alias("key"), "o_totalprice"
    )
    return merge(t.customer.select("c_custkey"), orders, [{"left": "c_custkey", "right": "key"}], "inner", keys_as="loose")


@query(
    "merge_summary",
    """SELECT m.match, coalesce(n, 0) AS count FROM (VALUES ('both'), ('left_only'), ('right_only')) m(match)
       LEFT JOIN (SELECT CASE WHEN o_custkey IS NULL THEN 'left_only' WHEN c_custkey IS NULL THEN 'right_only' ELSE 'both' END AS match,
                         count(*) AS n FROM customer FULL OUTER JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey GROUP BY 1) g
         ON m.match = g.match""",
)
def _(t):
    return match_summary(t.customer, t.orders, _KEYS, "outer")


@query(
    "merge_summary_inner",
    """SELECT 'both' AS match, count(*) AS count FROM customer JOIN orders ON c_custkey = o_custkey
       UNION ALL SELECT 'left_only', 0 UNION ALL SELECT 'right_only', 0""",
)
def _(t):
    return match_summary(t.customer, t.orders, _KEYS, "inner")


@query(
    "key_coverage",
    """SELECT c_custkey, 'both' AS match FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
       UNION ALL SELECT c_custkey, 'left_only' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
       UNION ALL SELECT o_custkey, 'right_only' FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""",
)
def _(t):
    return key_coverage(t.customer, t.orders, _KEYS)


@query(
    "blocked_pairs",
    """SELECT e.event_id AS "left.event_id", o.o_orderkey AS "right.o_orderkey" FROM events e JOIN orders o ON e.user_id = o.o_custkey""",
)
def _(t):
    return blocked_pairs(t.events, t.orders, [{"left": "user_id", "right": "o_custkey"}], ["event_id"], ["o_orderkey"])


@query(
    "fuzzy_join",
    """WITH l AS (SELECT o_orderkey, o_custkey, lower(o_orderpriority) || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS note FROM orders),
            r AS (SELECT o_orderkey, o_custkey, replace(lower(o_orderpriority), 'i', 'y') || strftime(o_orderdate, ' %Y/%m/%d') AS memo FROM orders)
       SELECT l.o_orderkey AS "left.o_orderkey", r.o_orderkey AS "right.o_orderkey", round(jaro_winkler_similarity(note, memo), 6) AS score
       FROM l JOIN r ON l.o_custkey = r.o_custkey WHERE round(jaro_winkler_similarity(note, memo), 12) >= 0.85""",
)
def _(t):
    priority = F.lower("o_orderpriority")
    left = t.orders.select(
        "o_orderkey", "o_custkey", F.concat(priority, F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("note")
    )
    right = t.orders.select(
        "o_orderkey", "o_custkey",
        F.concat(F.replace(priority, F.lit("i"), F.lit("y")), F.lit(" "), F.date_format("o_orderdate", "yyyy/MM/dd")).alias("memo"),
    )
    joined = fuzzy_join(
        left, right, [{"left": "o_custkey", "right": "o_custkey"}], [{"left": "note", "right": "memo"}],
        ["o_orderkey"], ["o_orderkey"],
    )
    return joined.withColumn("score", F.round("score", 6))


@query(
    "fuzzy_join_codes",
    """WITH l AS (SELECT o_orderkey, o_custkey, md5(CAST(o_orderkey AS VARCHAR)) AS code FROM orders),
            r AS (SELECT o_orderkey, o_custkey, replace(md5(CAST(o_orderkey AS VARCHAR)), 'a', '') AS code FROM orders)
       SELECT l.o_orderkey AS "left.o_orderkey", r.o_orderkey AS "right.o_orderkey", round(jaro_winkler_similarity(l.code, r.code), 6) AS score
       FROM l JOIN r ON l.o_custkey = r.o_custkey WHERE round(jaro_winkler_similarity(l.code, r.code), 12) >= 0.85""",
)
def _(t):
    code = F.md5(F.col("o_orderkey").cast("string"))
    left = t.orders.select("o_orderkey", "o_custkey", code.alias("code"))
    right = t.orders.select("o_orderkey", "o_custkey", F.replace(code, F.lit("a"), F.lit("")).alias("code"))
    joined = fuzzy_join(
        left, right, [{"left": "o_custkey", "right": "o_custkey"}], [{"left": "code", "right": "code"}],
        ["o_orderkey"], ["o_orderkey"],
    )
    return joined.withColumn("score", F.round("score", 6))


@query(
    "union_common",
    """SELECT name, nationkey, acctbal FROM (SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
       UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier)""",
)
def _(t):
    c = t.customer.toDF("custkey", "name", "nationkey", "acctbal", "mktsegment")
    s = t.supplier.toDF("suppkey", "name", "nationkey", "acctbal")
    return union_common(c, s)


@query(
    "union_widened",
    """SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(c_name AS VARCHAR) AS what FROM customer
       UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders""",
)
def _(t):
    return union_common(
        t.customer.select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("what")),
        t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("what")),
    )


@query(
    "union_strict",
    "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT s_nationkey, s_name FROM supplier",
)
def _(t):
    return union_strict(
        t.nation.select(F.col("n_nationkey").alias("Key "), F.col("n_name").alias("name")),
        t.supplier.select(F.col("s_name").alias("NAME"), F.col("s_nationkey").alias("key")),
        loose_names=True,
    )


@query(
    "union_all_columns",
    "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier UNION ALL BY NAME SELECT * FROM part",
)
def _(t):
    return union_all_columns([t.customer, t.supplier, t.part])


_LONG_KEYS = "1234567890123456789012345678901234567890"


@query(
    "merge_loose_big_keys",
    f"""SELECT c_custkey, key, n FROM (SELECT c_custkey, '{_LONG_KEYS}' || CAST(c_custkey AS VARCHAR) AS long_key FROM customer)
       JOIN (SELECT '{_LONG_KEYS}' || CAST(o_custkey AS VARCHAR) || '.0' AS key, count(*) AS n FROM orders GROUP BY o_custkey) ON long_key || '.0' = key""",
)
def _(t):
    """Numbers in texts of more than forty digits: neighbours stay apart, notations agree."""
    people = t.customer.select("c_custkey", F.concat(F.lit(_LONG_KEYS), F.col("c_custkey").cast("string")).alias("long_key"))
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.concat(F.lit(_LONG_KEYS), F.col("o_custkey").cast("string"), F.lit(".0")).alias("key"), "n")
    return merge(people, counts, [{"left": "long_key", "right": "key"}], "inner", keys_as="loose").drop("long_key")


@query(
    "merge_bigint_double",
    """SELECT big, half FROM (SELECT 9007199254740992 + c_custkey AS big FROM customer)
       JOIN (SELECT CAST(9007199254740992 + 2 * c_custkey AS DOUBLE) AS half FROM customer) ON CAST(big AS HUGEINT) = CAST(half AS HUGEINT)""",
)
def _(t):
    """Whole numbers beyond 2^53 meet fractions exactly: only those that a double can hold find a partner."""
    big = t.customer.select((F.col("c_custkey") + F.lit(9007199254740992)).alias("big"))
    half = t.customer.select((F.col("c_custkey") * 2 + F.lit(9007199254740992)).cast("double").alias("half"))
    return merge(big, half, [{"left": "big", "right": "half"}], "inner")
