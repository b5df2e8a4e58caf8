"""Recorded steps replayed over new inputs."""

from pyspark.sql import functions as F

from tallyframe.plans.replay import replay
from tallyframe.queries.registry import query
from tallyframe.streaming.rowlocal import transform

FLAGSHIP_SQL = """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_quantity), 4) AS l_quantity, count(l_orderkey) AS l_orderkey
FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' AND l_quantity < 45 GROUP BY l_returnflag, l_linestatus"""

FLAGSHIP_STEPS = [
    {"sequence": 1, "operation": "sort_filter", "parameters": {
        "tableName": "lines", "outputTableName": "shipped", "sortConfig": [], "filterConfig": [
            {"column": "l_shipdate", "operator": "less_than", "value": "1998-09-02"},
            {"column": "l_quantity", "operator": "less_than", "value": 45}]}},
    {"sequence": 2, "operation": "add_column", "parameters": {
        "tableName": "shipped", "newColumnName": "revenue", "operationType": "calculate", "operations": [
            {"column1": "l_discount", "operator": "*", "fixed_value": -1},
            {"operator": "+", "fixed_value": 1},
            {"operator": "*", "column2": "l_extendedprice"}]}},
    {"sequence": 3, "operation": "group_pivot", "parameters": {
        "tableName": "shipped", "outputTableName": "totals", "rowIndex": ["l_returnflag", "l_linestatus"], "columnIndex": None,
        "pivotValues": [
            {"column": "revenue", "aggregation": "sum"}, {"column": "l_quantity", "aggregation": "mean"},
            {"column": "l_orderkey", "aggregation": "count"}]}},
    {"sequence": 4, "operation": "sort_filter", "parameters": {
        "table_name": "totals", "output_table_name": "report", "filter_config": [],
        "sort_config": [{"column": "l_returnflag", "order": "asc"}, {"column": "l_linestatus", "order": "desc"}]}},
]


@query("flagship_revenue", FLAGSHIP_SQL)
def flagship(t):
    run = replay(FLAGSHIP_STEPS, {"lineitem": t.lineitem}, {"lines": "lineitem"}, on_error="stop")
    report = run.tables["report"]
    return report.select(
        "l_returnflag", "l_linestatus", F.round("revenue", 2).alias("revenue"), F.round("l_quantity", 4).alias("l_quantity"), "l_orderkey"
    )


@query(
    "replay_merge_edit",
    """SELECT "Customer", segment, round(sum(o_totalprice), 2) AS spent FROM (
         SELECT c_name AS "Customer", CASE WHEN lower(c_mktsegment) = 'machinery' THEN 'Machines' ELSE c_mktsegment END AS segment, o_totalprice
         FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice >= 1000)
       GROUP BY "Customer", segment HAVING sum(o_totalprice) > 500000""",
)
def _(t):
    steps = [
        {"sequence": 3, "operation": "replace_rename_reorder", "parameters": {
            "tableName": "joined", "outputTableName": "named", "operations": [
                {"type": "rename_columns", "mapping": {"c_name": "Customer", "c_mktsegment": "segment"}},
                {"type": "replace_values", "replacements": [
                    {"column": "c_mktsegment", "oldValue": "machinery", "newValue": "Machines", "matchCase": False}]}]}},
        {"sequence": 1, "operation": "sort_filter", "parameters": {
            "tableName": "orders_2007", "outputTableName": "big", "filterConfig": [
                {"column": "o_totalprice", "operator": "greater_equals", "value": "1000"}]}},
        {"sequence": 2, "operation": "merge_files", "parameters": {
            "table1Name": "clients", "table2Name": "big", "mergeType": "horizontal", "mergeMethod": "inner",
            "keyPairs": [{"left": "c_custkey", "right": "o_custkey"}], "showCountSummary": True, "outputTableName": "joined"}},
        {"sequence": 4, "operation": "group_pivot", "parameters": {
            "tableName": "named", "outputTableName": "spent", "rowIndex": ["Customer", "segment"],
            "pivotValues": [{"column": "o_totalprice", "aggregation": "sum"}]}},
        {"sequence": 5, "operation": "sort_filter", "parameters": {
            "tableName": "spent", "outputTableName": "top", "filterConfig": [
                {"column": "o_totalprice", "operator": "greater_than", "value": 500000}]}},
    ]
    run = replay(steps, {"orders": t.orders, "customer": t.customer}, {"orders_2007": "orders", "clients": "customer"}, on_error="stop")
    return run.tables["top"].select("Customer", "segment", F.round("o_totalprice", 2).alias("spent"))


@query(
    "replay_reconcile",
    """SELECT CASE WHEN "o_orderkey" IS NULL THEN 'open' ELSE 'settled' END AS state, count(*) AS lines, round(sum(l_extendedprice), 2) AS total
       FROM (SELECT l_orderkey, sum(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey) r
       LEFT JOIN (SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f') l ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    steps = [
        {"sequence": 1, "operation": "sort_filter", "parameters": {
            "tableName": "orders", "outputTableName": "finished", "filterConfig": [
                {"column": "o_orderstatus", "operator": "equals", "value": "f"}]}},
        {"sequence": 2, "operation": "reconcile_files", "parameters": {
            "sourceTableNames": ["finished", "lineitem"], "outputTableName1": "orders_out", "outputTableName2": "lines_out",
            "keys": [{"left": "o_orderkey", "right": "l_orderkey", "criteria": "exact"}],
            "values": [{"left": "o_totalprice", "right": "l_extendedprice", "threshold_type": "percent", "threshold_value": 5}],
            "settings": {"method": "one-to-many"}, "crossReference": {"left": ["o_orderkey"], "right": []}}},
        {"sequence": 3, "operation": "add_column", "parameters": {
            "tableName": "lines_out", "newColumnName": "state", "operationType": "conditional", "sourceColumn": "Reco_Status",
            "conditions": [{"operator": "equals", "reference_value": "Matched", "conditional_value": "settled"}], "residualValue": "open"}},
    ]
    run = replay(steps, {"orders": t.orders, "lineitem": t.lineitem}, on_error="stop")
    return run.tables["lines_out"].groupBy("state").agg(
        F.count("l_orderkey").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


@query(
    "row_local_steps",
    """SELECT event_id, user_id AS "who", value, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS value__style, round(value * 1.2 - 1, 4) AS gross
       FROM events WHERE event_type <> 'error' AND value >= 5""",
)
def _(t):
    made = transform(t.events.select("event_id", "user_id", "event_type", "value"), [
        {"step": "filter", "rules": [
            {"column": "event_type", "operator": "not_equals", "value": "Error"},
            {"column": "value", "operator": "greater_equals", "value": 5}]},
        {"step": "add_column", "name": "gross", "kind": "calculate", "spec": {"operations": [
            {"column1": "value", "operator": "*", "fixed_value": 1.2}, {"operator": "-", "fixed_value": 1}]}},
        {"step": "edit", "operations": [
            {"type": "delete_columns", "columns": ["event_type"]}, {"type": "rename_columns", "mapping": {"user_id": "who"}}]},
        {"step": "format", "configs": [
            {"type": "Conditional Formatting", "location": {"range": "value"}, "format": {"conditional": {
                "operator": "greater than", "value": 100, "trueFormat": "high", "falseFormat": "low"}}}]},
    ])
    return made.withColumn("gross", F.round("gross", 4))
