"""Replay, adapters, schema checks and streams."""

import pytest

from tallyframe.plans.replay import (
    Tables,
    active_steps,
    chart_dataset,
    check_inputs,
    copy_steps,
    delete_step,
    reorder_steps,
    replay,
)
from tallyframe.plans.specs import describe, missing_columns, step_parameters
from tallyframe.streaming.rowlocal import drain, read_stream, transform


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 3.0), (2, "Bob", None), (3, "Cy", 9.0)], "id int, name string, v double")


def step(sequence, operation, **parameters):
    return {"id": int(sequence * 10), "sequence": sequence, "operation": operation, "parameters": parameters}


STEPS = [
    step(2, "add_column", tableName="big", newColumnName="twice", operationType="calculate",
         operations=[{"column1": "v", "operator": "*", "fixed_value": 2}]),
    step(1, "sort_filter", table_name="src", output_table_name=" big ", sort_config=[],
         filter_config=[{"column": "v", "operator": "greater_than", "value": 1}]),
]


def test_replay_orders_maps_and_reports(people):
    run = replay(STEPS, {"people": people}, {"src": "people"})
    assert [r["status"] for r in run.results] == ["completed", "completed"]
    assert sorted(tuple(r) for r in run.tables["big"].collect()) == [(1, "Ann", 3.0, 6.0), (3, "Cy", 9.0, 18.0)]
    assert run.summary() == {"total_operations": 2, "completed": 2, "errors": 0, "skipped": 0, "success_rate": "100.00%"}


def test_replay_counts_every_kind_of_error(spark, people):
    steps = [
        step(1, "sort_filter", tableName="people", outputTableName="a", sortConfig=[{"column": "gone", "order": "asc"}]),
        step(2, "add_column", tableName="people", newColumnName="x", operationType="mystery"),
        step(3, "merge_files", table1Name="people", table2Name="nobody", outputTableName="m"),
        step(4, "group_pivot", tableName="people", outputTableName="g", rowIndex=["name"], pivotValues=[{"column": "v", "aggregation": "sum"}]),
        step(5, "dance"), {**step(6, "sort_filter"), "is_active": False},
        step(7, "sort_filter", tableName="people", outputTableName="people", filterConfig=[]),
    ]
    run = replay(steps, {"people": people})
    assert [r["status"] for r in run.results] == ["error", "error", "error", "completed", "error", "error"]
    assert "gone" in run.results[0]["error"] and "already exists" in run.results[-1]["error"]
    assert run.status_table(spark).filter("status = 'error'").count() == 5
    stopped = replay(steps, {"people": people}, on_error="stop")
    assert [r["status"] for r in stopped.results] == ["error"] + ["skipped"] * 5
    assert stopped.summary()["skipped"] == 5


def test_replay_other_steps(people):
    steps = [
        step(1, "edit_file", tables=[{"tableName": "people", "columnSelections": ["id", "v", "name"], "columnTypes": {"id": "str"}}]),
        step(2, "merge_files", table1Name="people", table2Name="people", mergeType="vertical", outputTableName="both"),
        step(3, "merge_files", table1Name="people", table2Name="both", mergeType="horizontal", mergeMethod="left",
             keyPairs=[{"left": "id", "right": "id"}], showCountSummary=True, outputTableName="joined"),
        step(4, "apply_formatting", tableName="people", formattingConfigs=[
            {"type": "Conditional Formatting", "location": {"range": "C"}, "format": {"conditional": {
                "operator": "greater than", "value": 5, "trueFormat": "T", "falseFormat": "F"}}}]),
        step(5, "group_pivot", tableName="both", outputTableName="pivoted", rowIndex="id", columnIndex="name",
             pivotValues=[{"column": "v", "aggregation": "count"}]),
    ]
    run = replay(steps, {"people": people})
    assert [r["error"] for r in run.results] == [None] * 5
    assert run.tables["people"].dtypes[0] == ("id", "string")
    assert run.tables["joined"].count() == 6 and run.tables["joined_summary"].count() == 3
    assert [r["v__style"] for r in run.tables["formatted_people"].orderBy("id").collect()] == ["F", None, "T"]
    assert run.tables["pivoted"].columns == ["id", "v|Ann", "v|Bob", "v|Cy"]


def test_replay_reconcile(people):
    run = replay([step(1, "reconcile", sourceTableNames=["people", "other"], outputTableName="reco",
                       keys=[{"left": "id", "right": "id", "criteria": "exact"}], values=[{"left": "v", "right": "v"}],
                       settings={"method": "one-to-one", "duplicate": "first_occurrence", "basis_table": "other"})],
                 {"people": people, "other": people})
    assert run.results[0]["error"] is None
    assert run.tables["reco_left"].filter("Reco_Status = 'Matched'").count() == 3
    assert {tuple(r) for r in run.tables["reco_statistics"].collect()} == {("left", 3, 0), ("right", 3, 0)}


def test_older_reconcile_fields():
    p = step_parameters("reconcile_files", {
        "files": ["a", "b"],
        "matching_keys": [{"file1_column": "x", "file2_column": "y", "method": "fuzzy", "case_sensitive": False, "ignore_special_characters": True}],
        "values": [{"file1_column": "v", "file2_column": "w", "threshold_type": "Percent", "threshold_value": 5}],
        "reconciliation_settings": {"method": "one-to-one", "handling_duplicate_matches": "closest", "based_on_columns": {"file1": "d", "file2": "e"}},
        "cross_reference": {"file1_column": "x", "file2_column": 0},
    })
    assert p["keys"] == [{"left": "x", "right": "y", "criteria": "fuzzy", "case_sensitive": "no", "ignore_special": "yes", "fuzzy_ranking_basis": False}]
    assert p["values"] == [{"left": "v", "right": "w", "threshold_type": "percent", "threshold_value": 5}]
    assert p["settings"]["duplicate"] == "closest" and p["settings"]["basis_column"] == {"left": "d", "right": "e"}
    assert p["crossReference"] == {"left": ["x"], "right": ["__Custom__"]} and p["sourceTableNames"] == ["a", "b"]
    nested = step_parameters("reconcile_files", {"sourceTableNames": ["a", "b"], "keys": [], "values": [], "crossReference": {
        "left": ["x"], "right": [], "settings": {"method": "one-to-one", "duplicate": "first_occurrence", "basis_column": {"left": "x", "right": "x"}}}})
    assert nested["settings"]["method"] == "one-to-one" and nested["crossReference"]["left"] == ["x"]


def test_missing_columns():
    have = ["Depot", "Weight"]
    label = [{"column": "Batch", "type": "Left", "n": 2}, {"column": "weight", "type": "Full text"}, {"column": "Shelf", "type": "Right", "n": 1}]
    assert missing_columns("add_column", {"operationType": "concatenate", "operations": label}, have) == ["Batch", "Shelf"]
    assert missing_columns("add_column", {"operationType": "concatenate", "operations": label[1:2]}, have) == []
    assert missing_columns("sort_filter", {"sort_config": [{"column": "depot"}], "filterConfig": [{"column": "Weight"}]}, have) == ["depot"]
    assert missing_columns("merge_files", {"keyPairs": [{"left": "Depot", "right": "Depot"}]}, have, ["x"]) == ["Depot"]
    assert missing_columns("reconcile", {"keys": [{"left": "Depot", "right": "k"}], "values": [], "crossReference": {"left": ["q", "__Custom__"]}}, have, ["k"]) == ["q"]
    assert missing_columns("group_pivot", {"rowIndex": "Depot", "columnIndex": "z", "pivotValues": [{"column": "y"}]}, have) == ["z", "y"]
    assert missing_columns("format", {"formattingConfigs": [{"location": {"range": "Depot, Gone, A"}}]}, have) == ["Gone"]
    edits = [{"type": "rename_columns", "mapping": {"a": "b"}}, {"type": "reorder_columns", "order": ["Depot", "c"]}, {"type": "replace_values", "replacements": [{"column": "d"}]}]
    assert missing_columns("replace_rename_reorder", {"operations": edits}, have) == ["a", "c", "d"]


def test_descriptions():
    assert describe("sort_filter", {"tableName": "t", "sort_config": [{"column": "a", "order": "asc"}], "filter_config": [{"column": "b"}]}) == "t: ordered by a; rows chosen by b"
    edits = [{"type": "rename_columns", "mapping": {"a": "z"}}, {"type": "replace_values", "replacements": [{"column": "z"}]}]
    assert describe("replace_rename_reorder", {"tableName": "t", "operations": edits}) == "t: new names for a; new values in z"
    assert describe("replace_rename_reorder", {"tableName": "t", "operations": []}) == "t: unchanged"


def test_step_edits():
    steps = [step(1, "sort_filter"), step(2, "group_pivot"), step(3, "format")]
    assert [s["operation"] for s in reorder_steps(steps, [{"id": 30, "sequence": 0.5}])] == ["format", "sort_filter", "group_pivot"]
    assert [(s["operation"], s["sequence"]) for s in delete_step(steps, 10)] == [("group_pivot", 1.0), ("format", 2.0)]
    assert [s["id"] for s in copy_steps(steps)] == [1, 2, 3] and len(active_steps(steps)) == 3
    with pytest.raises(ValueError):
        reorder_steps(steps, [{"id": 99, "sequence": 1}])


def test_table_names(people):
    tables = Tables({"a": people})
    tables.put("t1", people, temporary=True)
    tables.put("t2", people, temporary=True)
    tables.put("t2", people.limit(1), temporary=True)
    with pytest.raises(ValueError):
        tables.put("a", people)
    tables.put("a", people, policy="overwrite")
    tables.keep("t2")
    assert tables.names() == ["a", "t2"] and "t1" not in tables


def test_input_schemas(people):
    expected = {"src": {"id": "integer", "name": "date", "x": "float"}, "gone": {}}
    report = check_inputs(expected, {"people": people}, {"src": "people"})
    assert [(p["column"], p["status"]) for p in report["src"]] == [("name", "type mismatch"), ("x", "missing"), ("v", "extra")]
    assert report["gone"][0]["status"] == "table missing"


def test_chart_datasets(people):
    assert chart_dataset(people, {"type": "Donut", "labels": "name", "values": "v", "largestItems": 1}).collect() == [("Cy", 9.0)]
    assert chart_dataset(people, {"type": "horizontal", "xAxis": "name", "series": [{"column": "v"}]}).columns == ["name", "series", "value"]
    assert chart_dataset(people, {"type": "line", "xAxis": "name", "series": [{"column": "v"}, {"column": "id"}]}).count() == 6


def test_stream_equals_batch(spark, people, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    people.repartition(2).write.parquet(source)
    steps = [
        {"step": "filter", "rules": [{"column": "v", "operator": "greater_than", "value": 1}]},
        {"step": "add_column", "name": "twice", "kind": "calculate", "spec": {"operations": [{"column1": "v", "operator": "*", "fixed_value": 2}]}},
        {"step": "edit", "operations": [{"type": "rename_columns", "mapping": {"name": "who"}}]},
    ]
    stream = transform(read_stream(spark, source, people.schema), steps)
    assert stream.isStreaming
    drain(stream, target, str(tmp_path / "checkpoint"))
    want = sorted(tuple(r) for r in transform(people, steps).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == want
    people.limit(1).write.mode("append").parquet(source)
    drain(transform(read_stream(spark, source, people.schema), steps), target, str(tmp_path / "checkpoint"))
    assert spark.read.parquet(target).count() == len(want) + transform(people.limit(1), steps).count()
    with pytest.raises(ValueError):
        transform(people, [{"step": "group"}])
