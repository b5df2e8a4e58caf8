from datetime import datetime

import pytest

from tallyframe.operators.predicates import filter_rows, predicate


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Alice", 90.5, True, datetime(2020, 5, 1, 8)), (2, "bob", 90.0, False, datetime(2020, 5, 2)),
         (3, None, None, None, None), (4, "BOB", 10.0, True, datetime(2021, 1, 1))],
        "id int, name string, score double, ok boolean, at timestamp_ntz",
    )


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(("column", "op", "value", "want"), [
    ("name", "equals", "Bob", [2, 4]),
    ("name", "not_equals", "Bob", [1, 3]),          # a missing value is not equal
    ("score", "greater_than", 90, [1]),             # fractions stay fractions
    ("score", "not_equals", "90", [1, 3, 4]),
    ("score", "less_equals", "90", [2, 4]),
    ("ok", "equals", "Yes", [1, 4]),
    ("ok", "not_equals", "true", [2, 3]),
    ("at", "equals", "01/05/2020", [1]),            # the day counts
    ("at", "not_equals", "01/05/2020", [1, 2, 3, 4]),  # the instant counts
    ("at", "not_equals", "2020-05-02", [1, 3, 4]),
    ("at", "greater_equals", "02-05-2020", [2, 4]),
    ("name", "contains", "O", [2, 4]),
    ("name", "contains", "b.b", []),                # literal unless asked for
    ("name", "not_contains", "o", [1, 3]),
    ("name", "starts_with", "a", [1]),
    ("name", "ends_with", "B", [2, 4]),
    ("name", "is_null", None, [3]),
    ("name", "is_not_null", None, [1, 2, 4]),
])
def test_token_dialect(people, column, op, value, want):
    assert ids(filter_rows(people, [{"column": column, "operator": op, "value": value}])) == want


@pytest.mark.parametrize(("column", "op", "value", "want"), [
    ("name", "equals", "bob", [2]),
    ("name", "does not equal", "bob", [1, 3, 4]),
    ("name", "begins with", "B", [4]),
    ("name", "does not begin with", "B", [1, 2, 3]),
    ("name", "does not end with", "b", [1, 3, 4]),
    ("name", "contains", "b.b", [2]),               # a regular expression here
    ("name", "does not contain", "o", [1, 3, 4]),
    ("score", "greater than or equal to", "90", [1, 2]),
    ("at", "less than", "2021-01-01", [1, 2]),
    ("name", "is null", None, [3]),
])
def test_word_dialect(people, column, op, value, want):
    assert ids(filter_rows(people, [{"column": column, "criteria": op, "value": value}], "word")) == want


def test_regex_option(people):
    assert ids(filter_rows(people, [{"column": "name", "operator": "contains", "value": "^B.b$", "regex": True}])) == [2, 4]


def test_rules_are_and_ed_and_pushed_down(spark, people, tmp_path):
    path = str(tmp_path / "people")
    people.write.parquet(path)
    df = filter_rows(spark.read.parquet(path), [
        {"column": "score", "operator": "greater_than", "value": 20}, {"column": "id", "operator": "less_than", "value": "2"},
    ])
    assert ids(df) == [1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(score,20.0)" in plan and "LessThan(id,2)" in plan


def test_unknown_operator_and_column(people):
    with pytest.raises(ValueError, match="unsupported operator"):
        predicate(people, "name", "resembles", "x")
    with pytest.raises(ValueError, match="not found"):
        predicate(people, "nom", "equals", "x")


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "`E1: Economy` int, `a.b` double, `x|y` string")
    rules = [{"column": "E1: Economy", "operator": "equals", "value": 1}, {"column": "a.b", "operator": "less_than", "value": 3},
             {"column": "x|y", "operator": "equals", "value": "X"}]
    assert filter_rows(df, rules).count() == 1
