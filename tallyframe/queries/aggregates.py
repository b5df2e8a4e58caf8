"""Group aggregates, pivots and chart datasets."""

from pyspark.sql import functions as F

from tallyframe.operators.charts import horizontal_bars, pie, series_long, series_wide
from tallyframe.operators.grouping import group_aggregate, pivot, sum_by_keys, value_counts
from tallyframe.queries.registry import query


def _rounded(df, names, digits=2):
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


@query(
    "group_agg",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice,
              min(l_discount) AS l_discount, max(l_tax) AS l_tax, count(l_partkey) AS l_partkey
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _(t):
    made = group_aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], [
        {"column": "l_quantity", "aggregation": "sum"},
        {"column": "l_extendedprice", "aggregation": "mean"},
        {"column": "l_discount", "aggregation": "min"},
        {"column": "l_tax", "aggregation": "max"},
        {"column": "l_partkey", "aggregation": "count"},
    ])
    return _rounded(_rounded(made, ["l_quantity"]), ["l_extendedprice"], 4)


@query(
    "group_agg_stats",
    """SELECT l_suppkey, round(median(l_extendedprice), 3) AS "l_extendedprice:median",
              round(stddev_samp(l_extendedprice), 3) AS "l_extendedprice:std", round(var_samp(l_quantity), 4) AS l_quantity
       FROM lineitem GROUP BY l_suppkey""",
)
def _(t):
    made = group_aggregate(t.lineitem, ["l_suppkey"], [
        {"column": "l_extendedprice", "aggregation": "median"},
        {"column": "l_extendedprice", "aggregation": "std"},
        {"column": "l_quantity", "aggregation": "var"},
    ])
    return _rounded(_rounded(made, ["l_extendedprice:median", "l_extendedprice:std"], 3), ["l_quantity"], 4)


@query(
    "group_first_last",
    """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS value FROM events)
       SELECT user_id, arg_min(event_type, event_id) AS event_type,
              arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM e GROUP BY user_id""",
)
def _(t):
    events = t.events.select(
        "user_id", "event_id", "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("value")
    )
    return group_aggregate(events, ["user_id"], [
        {"column": "event_type", "aggregation": "first"}, {"column": "value", "aggregation": "last"},
    ], order_by=["event_id"])


@query(
    "group_null_rules",
    """WITH e AS (SELECT CASE WHEN event_type <> 'view' THEN user_id END AS who, event_type,
                         CASE WHEN event_type <> 'click' THEN value END AS v, event_id FROM events)
       SELECT who, event_type, round(coalesce(sum(v), 0), 2) AS v, count(event_id) AS event_id FROM e
       WHERE who IS NOT NULL GROUP BY who, event_type""",
)
def _(t):
    events = t.events.select(
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("who"), "event_type",
        F.when(F.col("event_type") != "click", F.col("value")).alias("v"), "event_id",
    )
    return _rounded(group_aggregate(events, ["who", "event_type"], [
        {"column": "v", "aggregation": "sum"}, {"column": "event_id", "aggregation": "count"},
    ]), ["v"])


@query(
    "pivot_one",
    """SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS "o_totalprice|F",
              round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS "o_totalprice|O",
              round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 2) AS "o_totalprice|P"
       FROM orders GROUP BY o_orderpriority""",
)
def _(t):
    made = pivot(t.orders, "o_orderpriority", "o_orderstatus", [{"column": "o_totalprice", "aggregation": "sum"}])
    return _rounded(made, [c for c in made.columns if "|" in c])


@query(
    "pivot_multi_header",
    "SELECT l_linenumber, " + ", ".join(
        f"""count(l_orderkey) FILTER (WHERE l_returnflag = '{f}' AND l_linestatus = '{s}') AS "l_orderkey|{f}|{s}",
            max(l_quantity) FILTER (WHERE l_returnflag = '{f}' AND l_linestatus = '{s}') AS "l_quantity|{f}|{s}" """
        for f in "ANR" for s in "FO"
    ) + " FROM lineitem GROUP BY l_linenumber",
)
def _(t):
    return pivot(t.lineitem, ["l_linenumber"], ["l_returnflag", "l_linestatus"], [
        {"column": "l_quantity", "aggregation": "max"}, {"column": "l_orderkey", "aggregation": "count"},
    ])


@query(
    "pivot_number_header",
    "SELECT l_returnflag, " + ", ".join(
        f"""round(avg(l_extendedprice) FILTER (WHERE l_linenumber = {n}), 3) AS "l_extendedprice|{n}" """ for n in range(1, 8)
    ) + " FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    made = pivot(t.lineitem, "l_returnflag", "l_linenumber", [{"column": "l_extendedprice", "aggregation": "mean"}])
    return _rounded(made, [c for c in made.columns if "|" in c], 3)


@query(
    "value_counts",
    "SELECT p_type, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type",
)
def _(t):
    return value_counts(t.part, "p_type")


@query(
    "sum_by_keys",
    "SELECT l_orderkey, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY l_orderkey",
)
def _(t):
    return _rounded(sum_by_keys(t.lineitem, ["l_orderkey"], ["l_extendedprice", "l_quantity"]), ["l_extendedprice", "l_quantity"])


@query(
    "pie_topk",
    """SELECT l_partkey, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY l_partkey
       ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 10""",
)
def _(t):
    return _rounded(pie(t.lineitem, "l_partkey", "l_quantity", 10), ["l_quantity"])


@query(
    "pie_all",
    "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY c_mktsegment",
)
def _(t):
    return _rounded(pie(t.customer, "c_mktsegment", "c_acctbal"), ["c_acctbal"])


@query("series_wide", "SELECT o_orderdate, o_totalprice, o_custkey FROM orders")
def _(t):
    return series_wide(t.orders, "o_orderdate", [{"column": "o_totalprice"}, {"column": "o_custkey"}])


@query(
    "series_long",
    """SELECT l_shipdate, 'l_quantity' AS series, 'Line' AS type, 'Left' AS axis, l_quantity AS value FROM lineitem
       UNION ALL SELECT l_shipdate, 'l_extendedprice', 'Bar', 'Right', l_extendedprice FROM lineitem""",
)
def _(t):
    return series_long(t.lineitem, "l_shipdate", [
        {"column": "l_quantity", "type": "Line", "axis": "Left"},
        {"column": "l_extendedprice", "type": "Bar", "axis": "Right"},
    ])


@query(
    "horizontal_bars",
    """SELECT s_name, 's_acctbal' AS series, s_acctbal AS value FROM supplier
       UNION ALL SELECT s_name, 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier""",
)
def _(t):
    return horizontal_bars(t.supplier, "s_name", [{"column": "s_acctbal"}, {"column": "s_nationkey"}])


@query(
    "pivot_mixed_case",
    """SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (WHERE flag = 'Yes'), 0), 2) AS "o_totalprice|Yes",
              round(coalesce(sum(o_totalprice) FILTER (WHERE flag = 'yes'), 0), 2) AS "o_totalprice|yes "
       FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'yes' END AS flag FROM orders) GROUP BY o_orderpriority""",
)
def _(t):
    """Headers that differ in case only are columns of their own; the second is renamed here, as SQL could not hold both."""
    flagged = t.orders.withColumn("flag", F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("yes"))
    made = pivot(flagged, "o_orderpriority", "flag", [{"column": "o_totalprice", "aggregation": "sum"}])
    return _rounded(made.toDF("o_orderpriority", "o_totalprice|Yes", "o_totalprice|yes "), ["o_totalprice|Yes", "o_totalprice|yes "])


@query(
    "pivot_null_rows",
    """SELECT nullif(o_orderstatus, 'P') AS state, count(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS "o_orderkey|1-URGENT",
              count(o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW') AS "o_orderkey|5-LOW"
       FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""",
)
def _(t):
    """A header that only rows without a key have gives no column."""
    rare = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW") | (F.col("o_orderstatus") == "P"))
    keyed = rare.withColumn("state", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    made = pivot(keyed, "state", "o_orderpriority", [{"column": "o_orderkey", "aggregation": "count"}])
    return made.select("state", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in made.columns[1:]])
