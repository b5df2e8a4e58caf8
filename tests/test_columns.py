from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.columns import add_column
from tallyframe.operators.edits import edit_batch, move, rename, replace_typed, typed_literal, unique_names
from tallyframe.operators.formatting import apply_formatting, parse_ranges, range_columns, select_range


def values(df, name="new"):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(
        [(1, 95.0, 0.0, "ab12cd3"), (2, 75.0, 4.0, "none"), (3, 10.0, None, None), (4, None, 2.0, "7")],
        "id int, score double, b double, text string",
    )


def test_fold_ignores_precedence(scores):
    df = add_column(scores, "new", "calculate", operations=[
        {"column1": "score", "operator": "+", "fixed_value": 5}, {"operator": "*", "fixed_value": 2},
        {"column1": "b", "operator": "-", "column2": "id"}])
    assert values(df) == [199.0, 158.0, 27.0, None]


def test_division_by_zero_is_null(scores):
    df = add_column(scores, "new", "calculate", operations=[{"column1": "score", "operator": "/", "column2": "b"}])
    assert values(df) == [None, 18.75, None, None]


def test_calculate_is_checked(scores):
    for ops in ([], [{"operator": "+", "fixed_value": 1}], [{"column1": "score", "operator": "%", "fixed_value": 1}],
                [{"column1": "score", "operator": "+"}], [{"column1": "text", "operator": "+", "fixed_value": 1}]):
        with pytest.raises(ValueError):
            add_column(scores, "new", "calculate", operations=ops)


def test_concatenate(spark):
    df = spark.createDataFrame([(1, "Anna", 1.0e7, 0.5), (2, None, 12345678.9, 3.0)], "id int, name string, big double, x double")
    made = add_column(df, "new", "concatenate", operations=[
        {"column": "name", "type": "Left", "chars": 2}, {"column": "name", "type": "Right", "chars": 1},
        {"column": "name", "type": "Right", "chars": 0}, {"column": "big", "type": "Full text"}, {"column": "x", "type": "Full text"}])
    assert values(made) == ["Ana10000000.00.5", "12345678.93.0"]


def test_overlapping_conditions(scores):
    """Conditions on text that overlap: the last one that holds decides, or the first one if asked for."""
    rules = [{"operator": "contains", "reference_value": "d3", "conditional_value": "code"},
             {"operator": "begins with", "reference_value": "ab", "conditional_value": "start"},
             {"operator": "ends with", "reference_value": "e", "conditional_value": "word"}]
    spec = {"sourceColumn": "text", "conditions": rules, "residualValue": "other"}
    assert values(add_column(scores, "new", "conditional", **spec)) == ["start", "word", "other", "other"]
    assert values(add_column(scores, "new", "conditional", first_match=True, **spec)) == ["code", "word", "other", "other"]

def test_pattern(scores):
    assert values(add_column(scores, "new", "pattern", sourceColumn="text", pattern=r"\d")) == ["123", None, None, "7"]
    assert values(add_column(scores, "new", "pattern", sourceColumn="text", pattern=r"([a-z])\d")) == ["bd", None, None, None]
    with pytest.raises(ValueError, match="one capture group"):
        add_column(scores, "new", "pattern", sourceColumn="text", pattern="(a)(b)")


def test_edit_batch_renames_last(scores):
    df = edit_batch(scores, [
        {"type": "rename_columns", "mapping": {"score": "points", "": "x", "gone": "y"}},
        {"type": "replace_values", "replacements": [
            {"column": "score", "oldValue": "95", "newValue": "96"}, {"column": "text", "oldValue": "NONE", "newValue": "-", "matchCase": False},
            {"column": "text", "oldValue": "a", "newValue": "z"}]},
        {"type": "reorder_columns", "order": ["text", "id"]}, {"type": "delete_columns", "columns": ["b", "gone"]}])
    assert df.columns == ["text", "id", "points"]
    assert values(df, "points") == [96.0, 75.0, 10.0, None]
    assert values(df, "text") == ["ab12cd3", "-", None, "7"]


def test_edit_errors(scores):
    with pytest.raises(ValueError):
        edit_batch(scores, [{"type": "reorder_columns", "order": ["gone"]}])
    with pytest.raises(ValueError):
        edit_batch(scores, [{"type": "shuffle"}])


def test_replace_typed(scores):
    assert values(replace_typed(scores, ["All"], "7", "8"), "text") == ["ab12cd3", "none", None, "8"]
    assert values(replace_typed(scores, ["b"], "null", "1.5"), "b") == [0.0, 4.0, 1.5, 2.0]
    assert values(replace_typed(scores, ["score"], "none", "8"), "score") == [95.0, 75.0, 10.0, None]
    assert typed_literal("2020-01-31") == datetime(2020, 1, 31)
    assert [typed_literal(v) for v in ("TRUE", "nan", "12", "1.5", "x")] == [True, None, 12, 1.5, "x"]


def test_names_and_order(scores):
    assert move(scores, "text", -2).columns == ["id", "text", "score", "b"]
    assert move(scores, "id", 99).columns == ["score", "b", "text", "id"]
    assert rename(scores, [{"column": "b", "newName": "c.d"}]).columns == ["id", "score", "c.d", "text"]
    assert unique_names(scores.selectExpr("id", "id", "id", "b")).columns == ["id", "id.2", "id.3", "b"]


def test_formats(scores):
    df = apply_formatting(scores, [
        {"type": "Cell Number Format", "location": {"range": "B"}, "format": {"numberFormat": "percentage"}},
        {"type": "Conditional Formatting", "location": {"range": "D"}, "format": {"conditional": {
            "operator": "greater than", "value": 5, "trueFormat": "hi", "falseFormat": "lo"}}},
        {"type": "Conditional Formatting", "location": {"range": "C"}, "format": {"conditional": {
            "operator": "does not contain", "value": "4", "trueFormat": "hi", "falseFormat": "lo"}}}])
    assert values(df, "score") == [0.95, 0.75, 0.1, None]
    assert values(df, "text__style") == [None, None, None, "hi"]
    assert values(df, "b__style") == ["hi", "lo", "hi", "hi"]
    assert values(df, "text") == ["ab12cd3", "none", None, "7"]


def test_ranges(scores):
    assert parse_ranges("A2:B, 3, C") == [
        {"columns": (0, 1), "rows": (2, None)}, {"columns": None, "rows": (3, 3)}, {"columns": (2, 2), "rows": (2, None)}]
    assert parse_ranges("AA1:AB4") == [{"columns": (26, 27), "rows": (1, 4)}]
    assert range_columns(scores, "B:C,text") == ["score", "b", "text"]
    for bad in ("A:", "?", ":B", "1A"):
        with pytest.raises(ValueError):
            parse_ranges(bad)
    assert [r.score for r in select_range(scores.withColumn("row", F.col("id")), "B2:B3", "row").collect()] == [95.0, 75.0]
    assert select_range(scores, "A:B").columns == ["id", "score"]
