"""Computed columns, edits and formats."""

from pyspark.sql import functions as F

from tallyframe.operators.columns import add_column
from tallyframe.operators.edits import drop, edit_batch, move, rename, reorder, replace_typed, select_source_order, unique_names
from tallyframe.operators.formatting import apply_formatting, select_range
from tallyframe.queries.registry import query


@query(
    "calc_fold",
    """SELECT l_orderkey, l_linenumber, round(((l_extendedprice * l_quantity) - l_tax) / NULLIF(l_discount, 0) + 10, 2) AS made
       FROM lineitem""",
)
def _(t):
    made = add_column(t.lineitem, "made", "calculate", operations=[
        {"column1": "l_extendedprice", "operator": "*", "column2": "l_quantity"},
        {"column1": None, "operator": "-", "column2": "l_tax"},
        {"operator": "/", "column2": "l_discount"},
        {"operator": "+", "fixed_value": 10},
    ])
    return made.select("l_orderkey", "l_linenumber", F.round("made", 2).alias("made"))


@query(
    "calc_sum_steps",
    """SELECT l_orderkey, l_linenumber, round((l_extendedprice * l_discount) + (l_quantity - 3) + (l_tax / NULLIF(l_discount, 0)), 4) AS made
       FROM lineitem""",
)
def _(t):
    made = add_column(t.lineitem, "made", "sum_steps", operations=[
        {"leftOperand": "l_extendedprice", "operator": "*", "rightOperand": "l_discount"},
        {"leftOperand": "l_quantity", "operator": "-", "rightOperand": "Fixed Value", "fixedValue": "3"},
        {"leftOperand": "l_tax", "operator": "/", "rightOperand": "l_discount"},
    ])
    return made.select("l_orderkey", "l_linenumber", F.round("made", 4).alias("made"))


@query(
    "concat_parts",
    """SELECT c_custkey, left(c_mktsegment, 3) || right(c_name, 4) || CAST(c_nationkey AS VARCHAR)
              || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) || '.0'
                      ELSE CAST(c_acctbal AS VARCHAR) END AS tag FROM customer""",
)
def _(t):
    return add_column(t.customer, "tag", "concatenate", operations=[
        {"column": "c_mktsegment", "type": "Left", "chars": 3},
        {"column": "c_name", "type": "Right", "chars": 4},
        {"column": "c_nationkey", "type": "Full text"},
        {"column": "c_acctbal", "type": "Full text"},
    ]).select("c_custkey", "tag")


_CONDITIONS = [
    {"operator": "greater than", "reference_value": "400000", "conditional_value": "large"},
    {"operator": "greater than or equal to", "reference_value": "150000", "conditional_value": "medium"},
    {"operator": "less than", "reference_value": "20000", "conditional_value": "tiny"},
]


@query(
    "conditional_last_match",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'tiny' WHEN o_totalprice >= 150000 THEN 'medium'
              WHEN o_totalprice > 400000 THEN 'large' ELSE 'small' END AS size FROM orders""",
)
def _(t):
    return add_column(
        t.orders, "size", "conditional", sourceColumn="o_totalprice", conditions=_CONDITIONS, residualValue="small"
    ).select("o_orderkey", "size")


@query(
    "conditional_first_match",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice >= 150000 THEN 'medium'
              WHEN o_totalprice < 20000 THEN 'tiny' ELSE 'small' END AS size FROM orders""",
)
def _(t):
    return add_column(
        t.orders, "size", "conditional", sourceColumn="o_totalprice", conditions=_CONDITIONS, residualValue="small",
        first_match=True,
    ).select("o_orderkey", "size")


@query(
    "conditional_text",
    """SELECT p_partkey, CASE WHEN NOT contains(p_name, 'e') THEN 'no e' WHEN contains(p_name, 'widget') THEN 'widget'
              WHEN NOT ends_with(p_name, 't') THEN 'not t' WHEN ends_with(p_name, 'ring') THEN 'ring'
              WHEN starts_with(p_name, 'b') THEN 'b' WHEN p_name <> 'red widget' THEN 'other'
              WHEN p_name = 'red widget' THEN 'red' ELSE 'none' END AS kind FROM part""",
)
def _(t):
    words = [
        ("equals", "red widget", "red"), ("does not equal", "red widget", "other"), ("begins with", "b", "b"),
        ("ends with", "ring", "ring"), ("does not end with", "t", "not t"), ("contains", "widget", "widget"),
        ("does not contain", "e", "no e"),
    ]
    conditions = [{"operator": o, "reference_value": r, "conditional_value": v} for o, r, v in words]
    return add_column(
        t.part, "kind", "conditional", sourceColumn="p_name", conditions=conditions, residualValue="none"
    ).select("p_partkey", "kind")


@query(
    "pattern_findall",
    """SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[0-9]+', 0)) > 0
              THEN array_to_string(regexp_extract_all(text, '[0-9]+', 0), '') END AS digits FROM documents""",
)
def _(t):
    return add_column(t.documents, "digits", "pattern", sourceColumn="text", pattern="[0-9]+").select("doc_id", "digits")


@query(
    "pattern_group",
    """SELECT p_partkey, CASE WHEN len(regexp_extract_all(p_brand, '#([0-9])', 1)) > 0
              THEN array_to_string(regexp_extract_all(p_brand, '#([0-9])', 1), '') END AS first_digit FROM part""",
)
def _(t):
    return add_column(t.part, "first_digit", "pattern", sourceColumn="p_brand", pattern="#([0-9])").select(
        "p_partkey", "first_digit"
    )


@query(
    "edit_batch",
    """SELECT CASE WHEN lower(o_orderstatus) = 'f' THEN 'Finished' WHEN o_orderstatus = 'O' THEN 'Open' ELSE o_orderstatus END AS status,
              o_orderkey AS "Order: key", CASE WHEN o_custkey = 5 THEN -5 ELSE o_custkey END AS o_custkey, o_totalprice,
              o_orderpriority AS "prio|text" FROM orders""",
)
def _(t):
    return edit_batch(t.orders, [
        {"type": "rename_columns", "mapping": {
            "o_orderstatus": "status", "o_orderkey": "Order: key", "o_orderpriority": "prio|text"}},
        {"type": "reorder_columns", "order": ["o_orderstatus", "o_orderkey"]},
        {"type": "replace_values", "replacements": [
            {"column": "o_orderstatus", "oldValue": "f", "newValue": "Finished", "matchCase": False},
            {"column": "o_orderstatus", "oldValue": "O", "newValue": "Open", "matchCase": True},
            {"column": "o_custkey", "oldValue": "5", "newValue": "-5", "matchCase": True},
        ]},
        {"type": "delete_columns", "columns": ["o_orderdate", "no such column"]},
    ])


@query(
    "replace_typed_all",
    """SELECT CASE WHEN p_partkey = 17 THEN 1000017 ELSE p_partkey END AS p_partkey, p_name, p_brand, p_type,
              CASE WHEN p_size = 17 THEN 1000017 ELSE p_size END AS p_size,
              CASE WHEN p_retailprice = 17 THEN 1000017 ELSE p_retailprice END AS p_retailprice FROM part""",
)
def _(t):
    return replace_typed(t.part, ["All"], "17", "1000017")


@query(
    "replace_typed_null",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN -1.0 ELSE value END AS value,
              CASE WHEN ts = TIMESTAMP '2024-01-01' THEN TIMESTAMP '2023-12-31' ELSE ts END AS ts FROM events""",
)
def _(t):
    events = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"), "ts")
    filled = replace_typed(events, ["value"], "null", "-1")
    return replace_typed(filled, ["ts"], "2024-01-01", "2023-12-31")


@query(
    "reshape_columns",
    """SELECT s_nationkey AS nation, s_suppkey, s_name FROM supplier""",
)
def _(t):
    df = move(t.supplier, "s_acctbal", -10)
    df = reorder(df, ["s_nationkey"])
    df = drop(df, ["s_acctbal", "no such column"])
    return rename(df, [{"column": "s_nationkey", "newName": "nation"}, {"column": "s_name", "newName": ""}])


@query(
    "select_and_dedupe_names",
    """SELECT n_name AS name, n_nationkey, r_name AS "name.2" FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def _(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    named = unique_names(joined.select(F.col("n_name").alias("name"), "n_nationkey", F.col("r_name").alias("name")))
    return select_source_order(named, {"name.2": True, "name": True, "n_nationkey": True})


@query(
    "style_flags",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_shipmark,
              CASE WHEN l_quantity > 31 THEN 'high' ELSE 'low' END AS l_quantity__style,
              CASE WHEN contains(lower(l_shipmark), 'a') THEN 'yes' ELSE 'no' END AS l_shipmark__style
       FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag || l_linestatus AS l_shipmark FROM lineitem)""",
)
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", F.concat("l_returnflag", "l_linestatus").alias("l_shipmark")
    )
    return apply_formatting(rows, [
        {"type": "Conditional Formatting", "location": {"range": "C"}, "format": {"conditional": {
            "operator": "greater than", "value": 31, "trueFormat": "high", "falseFormat": "low"}}},
        {"type": "Conditional Formatting", "location": {"range": "l_shipmark"}, "format": {"conditional": {
            "operator": "contains", "value": "A", "trueFormat": "yes", "falseFormat": "no"}}},
    ])


@query(
    "number_formats",
    """SELECT l_orderkey, l_linenumber, l_discount / 100 AS l_discount, TRY_CAST(l_returnflag AS DOUBLE) AS l_returnflag,
              CAST(l_shipdate AS TIMESTAMP) AS day
       FROM lineitem""",
)
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_discount", "l_returnflag", F.date_format("l_shipdate", "dd.MM.yyyy").alias("day")
    )
    return apply_formatting(rows, [
        {"type": "Cell Number Format", "location": {"range": "C"}, "format": {"numberFormat": "percentage"}},
        {"type": "Cell Number Format", "location": {"range": "D"}, "format": {"numberFormat": "number"}},
        {"type": "Cell Number Format", "location": {"range": "E"}, "format": {"numberFormat": "date"}},
    ])


@query(
    "range_columns",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders""",
)
def _(t):
    return select_range(t.orders, "A:B,E")
