"""Profiles, typing, cleaning and schema checks."""

from pyspark.sql import functions as F

from tallyframe.operators.clean import (
    drop_empty_columns,
    fill_blanks,
    fill_literal,
    format_result,
    infinite_to_null,
    standardise_key,
)
from tallyframe.operators.conformance import compare_profiles
from tallyframe.operators.profile import date_formats, logical_types, mixed_types, profile, summary, table_shape
from tallyframe.operators.typing import coerce_types, strict_types
from tallyframe.queries.registry import query

_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(
    "profile_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM orders"
        for c in _ORDERS
    ),
)
def _(t):
    return summary(t.orders)


def _mixed(t):
    return t.events.select(
        (F.col("event_id") * 0 + 1).alias("ones"),
        F.date_format("ts", "dd/MM/yyyy").alias("day"),
        F.date_format("ts", "yyyyMMdd").cast("long").alias("day_number"),
        F.col("user_id").cast("string").alias("user_text"),
        F.col("value").cast("string").alias("value_text"),
        "event_type",
        F.when(F.col("event_type") == "click", F.lit("Yes")).otherwise("no").alias("clicked"),
        F.when(F.col("value") > 20, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.col("event_type")).alias("half_dates"),
        F.when(F.col("value") < -1, "x").alias("empty"),
        "ts",
    )


# Shares of date-like text are counted in SQL as well, so the 70 % rule is checked on the data at hand.
_KINDS_SQL = """
WITH e AS (SELECT CAST(event_id * 0 + 1 AS VARCHAR) AS ones, strftime(ts, '%d/%m/%Y') AS day, strftime(ts, '%Y%m%d') AS day_number,
                  CAST(user_id AS VARCHAR) AS user_text, CAST(value AS VARCHAR) AS value_text, event_type,
                  CASE WHEN event_type = 'click' THEN 'Yes' ELSE 'no' END AS clicked,
                  CASE WHEN value > 20 THEN strftime(ts, '%Y-%m-%d') ELSE event_type END AS half_dates,
                  CAST(CASE WHEN value < -1 THEN 'x' END AS VARCHAR) AS empty, strftime(ts, '%Y-%m-%d') AS ts FROM events),
     long AS (SELECT "column", v FROM e UNPIVOT INCLUDE NULLS (v FOR "column" IN (ones, day, day_number, user_text, value_text, event_type, clicked, half_dates, empty, ts))),
     k AS (SELECT "column", count(v) AS n,
                  count(*) FILTER (WHERE lower(v) IN ('true','false','1','0','yes','no')) AS b,
                  count(*) FILTER (WHERE regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}|\\d{2}/\\d{2}/\\d{4}|\\d{8}')) AS shape,
                  count(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'), CASE WHEN length(v) = 8 THEN try_strptime(v, '%Y%m%d') END)) AS d,
                  count(TRY_CAST(v AS DOUBLE)) AS num,
                  count(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE))) AS whole
           FROM long GROUP BY 1)
SELECT "column", CASE WHEN n = 0 THEN 'string' WHEN b = n THEN 'boolean' WHEN shape > 0.7 * n AND d = n THEN 'date'
       WHEN whole = n THEN 'integer' WHEN num = n THEN 'float' WHEN d = n THEN 'date' ELSE 'string' END AS type FROM k
"""


@query("profile_types", _KINDS_SQL)
def _(t):
    return logical_types(_mixed(t))


@query(
    "profile_types_mixed",
    _KINDS_SQL.replace("'boolean'", """CASE WHEN "column" = 'ones' THEN 'integer' ELSE 'string' END""")
    .replace("WHEN shape > 0.7", """WHEN "column" = 'day_number' THEN 'integer' WHEN shape > 0.7"""),
)
def _(t):
    return mixed_types(_mixed(t))


@query(
    "profile_full",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM part"
        for c, k in (("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
                     ("p_size", "integer"), ("p_retailprice", "float"))
    ),
)
def _(t):
    return profile(t.part)


@query("table_shape", "SELECT count(*) AS row_count, 11 AS column_count FROM lineitem")
def _(t):
    return table_shape(t.lineitem)


@query(
    "date_formats",
    """SELECT 'iso' AS "column", CASE WHEN bool_and(try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') IS NOT NULL) THEN 'YYYY-MM-DD' END AS format FROM orders
       UNION ALL SELECT 'us', CASE WHEN bool_and(day(o_orderdate) <= 12) THEN 'DD/MM/YYYY' ELSE 'MM/DD/YYYY' END FROM orders
       UNION ALL SELECT 'dots', CASE WHEN count(*) > 0 THEN 'DD.MM.YYYY' END FROM orders
       UNION ALL SELECT 'none', CASE WHEN count(*) > 0 THEN 'YYYY-MM-DD' END FROM orders""",
)
def _(t):
    rows = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("dots"), F.col("o_orderpriority").alias("none"),
    )
    return date_formats(rows, ["iso", "us", "dots", "none"])


_PARTIAL = """CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y') WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y%m%d')
              WHEN '3-MEDIUM' THEN ' ' || strftime(o_orderdate, '%Y-%m') WHEN '5-LOW' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'n/a' END"""


def _partial_dates(t):
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.when(p == "1-URGENT", F.date_format(d, "yyyy")).when(p == "2-HIGH", F.date_format(d, "yyyyMMdd"))
        .when(p == "3-MEDIUM", F.concat(F.lit(" "), F.date_format(d, "yyyy-MM")))
        .when(p == "5-LOW", F.date_format(d, "dd/MM/yyyy")).otherwise("n/a").alias("day"),
    )


@query(
    "date_partial",
    f"""SELECT o_orderkey, CASE WHEN regexp_full_match(day, '\\d{{4}}') THEN CAST(day || '-01-01' AS DATE)
              WHEN regexp_full_match(day, '\\d{{8}}') THEN CAST(strptime(day, '%Y%m%d') AS DATE)
              WHEN regexp_full_match(trim(day), '\\d{{4}}-\\d{{2}}') THEN CAST(trim(day) || '-01' AS DATE)
              ELSE CAST(try_strptime(day, '%d/%m/%Y') AS DATE) END AS day
        FROM (SELECT o_orderkey, {_PARTIAL} AS day FROM orders)""",
)
def _(t):
    return coerce_types(_partial_dates(t), {"day": "datetime"}, {"day": "DD/MM/YYYY"})


@query(
    "typed_coerce",
    """SELECT event_id, CASE WHEN NOT contains(mixed, '.') THEN TRY_CAST(mixed AS BIGINT) END AS mixed, TRY_CAST(amount AS DOUBLE) AS amount,
              CAST(user_id AS VARCHAR) AS user_id
       FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN event_type WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) || '.5'
                                   ELSE CAST(900719925474000000 + user_id AS VARCHAR) END AS mixed,
                    CASE WHEN value > 50 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS amount, user_id FROM events)""",
)
def _(t):
    rows = t.events.select(
        "event_id",
        F.when(F.col("event_type") == "click", F.col("event_type")).when(F.col("event_type") == "view", F.concat(F.col("user_id").cast("string"), F.lit(".5")))
        .otherwise((F.lit(900719925474000000) + F.col("user_id")).cast("string")).alias("mixed"),
        F.when(F.col("value") > 50, "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
        "user_id",
    )
    return coerce_types(rows, {"mixed": "integer", "amount": "float", "user_id": "string", "no such column": "float"})


@query(
    "typed_strict",
    """SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS cust, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders""",
)
def _(t):
    rows = t.orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("cust"), F.col("o_totalprice").cast("string").alias("price"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), "o_orderpriority", "o_orderstatus",
    )
    chosen = {"o_orderkey": True, "day": True, "cust": True, "price": True, "o_orderpriority": True, "o_orderstatus": False}
    return strict_types(rows, chosen, {"day": "datetime"}, {"day": "DD.MM.YYYY"})


_HOLES = """SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS value, CASE WHEN event_type <> 'click' THEN event_type END AS kind,
            CASE WHEN event_type <> 'error' THEN ts END AS ts FROM events"""


def _holes(t):
    kind = F.col("event_type")
    return t.events.select(
        "event_id", F.when(kind != "view", F.col("value")).alias("value"), F.when(kind != "click", kind).alias("kind"),
        F.when(kind != "error", F.col("ts")).alias("ts"),
    )


@query(
    "null_fill",
    f"""SELECT event_id, coalesce(value, 0) AS value, coalesce(kind, '') AS kind, coalesce(ts, TIMESTAMP '1900-01-01') AS ts FROM ({_HOLES})""",
)
def _(t):
    return fill_blanks(_holes(t))


@query(
    "fill_display",
    f"""SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(kind, '-') AS kind FROM ({_HOLES})""",
)
def _(t):
    return fill_literal(_holes(t).select("event_id", "kind"), "-")


@query(
    "infinite_to_null",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio FROM lineitem",
)
def _(t):
    endless = F.lit(float("inf")) * F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(1.0)
    ratio = F.when(F.col("l_discount") == 0, endless).otherwise(F.try_divide("l_tax", "l_discount"))
    return infinite_to_null(t.lineitem.select("l_orderkey", "l_linenumber", ratio.alias("ratio")))


@query("drop_empty_columns", f"SELECT event_id, value, kind, ts FROM ({_HOLES})")
def _(t):
    rows = _holes(t).select("*", F.lit(1).alias("Unnamed: 4"), F.when(F.col("event_id") < 0, "x").alias("hollow"))
    return drop_empty_columns(rows)


@query(
    "format_result",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS \"Order Year\" FROM orders",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", F.year("o_orderdate").cast("double").alias("Order Year"))
    return format_result(rows)


@query(
    "standardise_key",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, strftime(o_orderdate, '%Y') AS \"Year\" FROM orders",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", F.col("o_orderdate").alias("Year"))
    return standardise_key(standardise_key(rows, "o_orderdate"), "Year")


_COMPARE = """
WITH a AS (SELECT 'key' AS c, CASE WHEN bool_and(c_custkey IS NOT NULL) THEN 'integer' END AS t FROM customer UNION ALL SELECT 'name', 'string'
           UNION ALL SELECT 'balance', CASE WHEN bool_and(c_acctbal = floor(c_acctbal)) THEN 'integer' ELSE 'float' END FROM customer
           UNION ALL SELECT 'segment', 'string'),
     b AS (SELECT 'key' AS c, CASE WHEN bool_and(s_suppkey IS NOT NULL) THEN 'integer' END AS t FROM supplier UNION ALL SELECT 'name', 'string'
           UNION ALL SELECT 'balance', CASE WHEN bool_and(round(s_acctbal) = floor(round(s_acctbal))) THEN 'integer' ELSE 'float' END FROM supplier
           UNION ALL SELECT 'nation', 'integer')
SELECT coalesce(a.c, b.c) AS "column", CASE WHEN b.c IS NULL THEN 'missing' WHEN a.c IS NULL THEN 'extra' WHEN a.t <> b.t THEN 'type mismatch' ELSE 'ok' END AS status,
       a.t AS expected, b.t AS actual FROM a FULL OUTER JOIN b ON a.c = b.c
"""


def _two_profiles(t):
    expected = t.customer.select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    actual = t.supplier.select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.round("s_acctbal").alias("balance"),
        F.col("s_nationkey").alias("nation"),
    )
    return logical_types(expected), logical_types(actual)


@query("schema_exact", _COMPARE)
def _(t):
    return compare_profiles(*_two_profiles(t))


@query("schema_superset", f"""SELECT * FROM ({_COMPARE}) WHERE status <> 'extra'""")
def _(t):
    return compare_profiles(*_two_profiles(t), allow_extra=True)


@query(
    "profile_small_fractions",
    """SELECT 'tiny' AS "column", count(*) AS rows, 0 AS nulls, count(DISTINCT o_totalprice / 1e12) AS "distinct" FROM orders
       UNION ALL SELECT 'zero', count(*), 0, 1 FROM orders""",
)
def _(t):
    """Distinct fractions far below the digits of a plain text, and zeros of both signs."""
    zero = F.when(F.col("o_orderkey") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-1.0) * F.lit(0.0))
    return summary(t.orders.select((F.col("o_totalprice") / F.lit(1e12)).alias("tiny"), zero.alias("zero")))
