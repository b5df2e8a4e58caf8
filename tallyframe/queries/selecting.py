"""Scans, filters, sorts and pages."""

import uuid

from pyspark.sql import functions as F

from tallyframe.operators.edits import select_requested_order
from tallyframe.operators.predicates import filter_rows
from tallyframe.operators.sorting import head, page, page_info, sort_filter
from tallyframe.queries.registry import query
from tallyframe.session import shared_folder
from tallyframe.sources.readers import read_table, tokens_to_null
from tallyframe.sources.writers import part_counts, write_table


@query("scan_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    return select_requested_order(t.customer, ["c_custkey", "c_name", "c_acctbal", "no such column"])


@query(
    "scan_null_tokens",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'NA') THEN NULL ELSE event_type END AS event_type FROM events""",
)
def _(t):
    return tokens_to_null(t.events.select("event_id", "event_type"), ("error", "NA"))


@query(
    "filter_tokens_numeric",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_totalprice > 100000 AND o_totalprice <= 400000.5 AND o_custkey >= 10 AND o_custkey < 1000000
         AND o_orderkey <> 7 AND o_custkey IS DISTINCT FROM 11""",
)
def _(t):
    return filter_rows(t.orders, [
        {"column": "o_totalprice", "operator": "greater_than", "value": "100000"},
        {"column": "o_totalprice", "operator": "less_equals", "value": 400000.5},
        {"column": "o_custkey", "operator": "greater_equals", "value": 10},
        {"column": "o_custkey", "operator": "less_than", "value": "1000000"},
        {"column": "o_orderkey", "operator": "not_equals", "value": 7},
        {"column": "o_custkey", "operator": "not_equals", "value": "11"},
    ]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_equals_numeric", "SELECT p_partkey, p_size, p_name FROM part WHERE p_size = 15")
def _(t):
    return filter_rows(t.part, [{"column": "p_size", "operator": "equals", "value": "15"}]).select(
        "p_partkey", "p_size", "p_name"
    )


@query(
    "filter_tokens_text",
    """SELECT p_partkey, p_name, p_type FROM part
       WHERE lower(p_type) = 'economy' AND lower(p_name) LIKE 'b%' AND lower(p_name) LIKE '%t'
         AND contains(lower(p_name), 'widget') AND NOT contains(lower(p_name), 'red')
         AND lower(p_brand) IS DISTINCT FROM 'brand#1'""",
)
def _(t):
    return filter_rows(t.part, [
        {"column": "p_type", "operator": "equals", "value": "Economy"},
        {"column": "p_name", "operator": "starts_with", "value": "B"},
        {"column": "p_name", "operator": "ends_with", "value": "T"},
        {"column": "p_name", "operator": "contains", "value": "WIDGET"},
        {"column": "p_name", "operator": "not_contains", "value": "Red"},
        {"column": "p_brand", "operator": "not_equals", "value": "brand#1"},
    ]).select("p_partkey", "p_name", "p_type")


@query(
    "filter_tokens_regex",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '^(red|blue) .*[lt]$')",
)
def _(t):
    return filter_rows(t.part, [
        {"column": "p_name", "operator": "contains", "value": "^(RED|blue) .*[LT]$", "regex": True},
    ]).select("p_partkey", "p_name")


@query(
    "filter_tokens_date",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate > TIMESTAMP '1996-03-31' AND o_orderdate <= TIMESTAMP '1999-06-30'
         AND o_orderdate IS DISTINCT FROM TIMESTAMP '1997-05-28'""",
)
def _(t):
    return filter_rows(t.orders, [
        {"column": "o_orderdate", "operator": "greater_than", "value": "31-03-1996"},
        {"column": "o_orderdate", "operator": "less_equals", "value": "1999-06-30"},
        {"column": "o_orderdate", "operator": "not_equals", "value": "28/05/1997"},
    ]).select("o_orderkey", "o_orderdate")


@query(
    "filter_tokens_day",
    "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'",
)
def _(t):
    return filter_rows(t.events, [{"column": "ts", "operator": "equals", "value": "05.01.2024"}]).select("event_id", "ts")


@query(
    "filter_tokens_null",
    """WITH e AS (SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS v,
                         CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events)
       SELECT event_id, kind FROM e WHERE v IS NULL AND kind IS NOT NULL AND lower(kind) IS DISTINCT FROM 'error'""",
)
def _(t):
    events = t.events.select(
        "event_id",
        F.when(F.col("event_type") == "click", F.col("value")).alias("v"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
    )
    return filter_rows(events, [
        {"column": "v", "operator": "is_null"},
        {"column": "kind", "operator": "is_not_null"},
        {"column": "kind", "operator": "not_equals", "value": "ERROR"},
    ]).select("event_id", "kind")


@query(
    "filter_words",
    """SELECT p_partkey, p_name, p_size, p_retailprice FROM part
       WHERE p_type = 'ECONOMY' AND p_brand IS DISTINCT FROM 'Brand#1' AND p_size > 3 AND p_size <= 40
         AND p_retailprice >= 905 AND p_retailprice < 999 AND starts_with(p_name, 'b')
         AND regexp_matches(p_name, 'w.dget|anvil') AND p_name IS NOT NULL""",
)
def _(t):
    return filter_rows(t.part, [
        {"column": "p_type", "criteria": "equals", "value": "ECONOMY"},
        {"column": "p_brand", "criteria": "does not equal", "value": "Brand#1"},
        {"column": "p_size", "criteria": "greater than", "value": "3"},
        {"column": "p_size", "criteria": "less than or equal to", "value": 40},
        {"column": "p_retailprice", "criteria": "greater than or equal to", "value": 905},
        {"column": "p_retailprice", "criteria": "less than", "value": "999"},
        {"column": "p_name", "criteria": "begins with", "value": "b"},
        {"column": "p_name", "criteria": "contains", "value": "w.dget|anvil"},
        {"column": "p_name", "criteria": "is not null"},
    ], "word").select("p_partkey", "p_name", "p_size", "p_retailprice")


@query(
    "filter_words_negative",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer
       WHERE NOT starts_with(c_mktsegment, 'B') AND NOT ends_with(c_mktsegment, 'Y')
         AND NOT regexp_matches(c_name, '#0+1') AND ends_with(c_name, '9')""",
)
def _(t):
    return filter_rows(t.customer, [
        {"column": "c_mktsegment", "criteria": "does not begin with", "value": "B"},
        {"column": "c_mktsegment", "criteria": "does not end with", "value": "Y"},
        {"column": "c_name", "criteria": "does not contain", "value": "#0+1"},
        {"column": "c_name", "criteria": "ends with", "value": "9"},
    ], "word").select("c_custkey", "c_name", "c_mktsegment")


@query(
    "filter_words_null",
    """WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events)
       SELECT event_id, kind FROM e WHERE kind IS NULL""",
)
def _(t):
    events = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return filter_rows(events, [{"column": "kind", "criteria": "is null"}], "word")


@query(
    "filter_words_date",
    """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1998-02-01' AND l_shipdate < TIMESTAMP '1998-03-01'""",
)
def _(t):
    return filter_rows(t.lineitem, [
        {"column": "l_shipdate", "criteria": "greater than or equal to", "value": "01/02/1998"},
        {"column": "l_shipdate", "criteria": "less than", "value": "1998-03-01"},
    ], "word").select("l_orderkey", "l_linenumber", "l_shipdate")


@query(
    "filter_text_as_number",
    """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_text FROM events)
       SELECT event_id, user_text FROM e WHERE TRY_CAST(user_text AS DOUBLE) > 42""",
)
def _(t):
    events = t.events.select("event_id", F.col("user_id").cast("string").alias("user_text"))
    return filter_rows(events, [{"column": "user_text", "operator": "greater_than", "value": "42"}])


@query(
    "filter_text_as_date",
    """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders)
       SELECT o_orderkey, day FROM o
       WHERE CAST(strptime(day, '%d/%m/%Y') AS DATE) >= DATE '1998-07-15'""",
)
def _(t):
    orders = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return filter_rows(orders, [{"column": "day", "operator": "greater_equals", "value": "15-07-1998"}])


@query(
    "sort_page",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       ORDER BY o_orderstatus DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 50 OFFSET 100""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return page(rows, [
        {"column": "o_orderstatus", "order": "desc"},
        {"column": "o_totalprice", "direction": "asc"},
        {"column": "o_orderkey", "order": "asc"},
    ], 3, 50)


@query(
    "page_count",
    "SELECT count(*) AS total_rows, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM lineitem",
)
def _(t):
    return page_info(t.lineitem, 25)


@query(
    "part_count",
    "SELECT count(*) AS rows, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS parts FROM lineitem",
)
def _(t):
    return part_counts(t.lineitem, 1000)


@query(
    "sort_head",
    """SELECT event_id, event_type, value FROM events
       ORDER BY value DESC NULLS LAST, event_id ASC NULLS LAST LIMIT 100""",
)
def _(t):
    rows = sort_filter(t.events.select("event_id", "event_type", "value"), [
        {"column": "value", "order": "desc"}, {"column": "event_id", "order": "asc"},
    ], [])
    return head(rows, 100)


@query(
    "sort_filter",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
       WHERE lower(c_mktsegment) = 'building' AND c_acctbal > 500""",
)
def _(t):
    return sort_filter(
        t.customer,
        [{"column": "c_acctbal", "order": "desc"}, {"column": "c_custkey", "order": "asc"}],
        [
            {"column": "c_mktsegment", "operator": "equals", "value": "building"},
            {"column": "c_acctbal", "operator": "greater_than", "value": 500},
        ],
    )


@query(
    "filter_big_keys",
    """SELECT k FROM (SELECT CAST(o_orderkey + 9007199254740000 AS BIGINT) AS k FROM orders) WHERE k >= 9007199254740993 AND k <> 9007199254741001""",
)
def _(t):
    rows = t.orders.select((F.col("o_orderkey") + F.lit(9007199254740000)).cast("bigint").alias("k"))
    return filter_rows(rows, [
        {"column": "k", "operator": "greater_equals", "value": "9007199254740993"},
        {"column": "k", "operator": "not_equals", "value": 9007199254741001},
    ])


@query(
    "scan_line_breaks",
    """SELECT o_orderkey, o_orderstatus || chr(10) || '"' || o_orderpriority || '",' || chr(13) || chr(10) || 'x' AS note, o_totalprice FROM orders""",
)
def _(t):
    """A table written as csv with line breaks, quotes and commas in its cells, and read back in splits."""
    note = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('",\r\nx'))
    path = f"{shared_folder(t.spark)}/csv-{uuid.uuid4().hex}"
    write_table(t.orders.select("o_orderkey", note.alias("note"), "o_totalprice"), path, "csv")
    return read_table(t.spark, path, "csv", schema="o_orderkey long, note string, o_totalprice double")
