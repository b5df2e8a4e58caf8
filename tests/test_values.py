"""Values that keep every digit, line breaks in csv cells, and names that stay apart."""

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.text import number_key
from tallyframe.operators.grouping import group_aggregate, pivot
from tallyframe.operators.joins import merge
from tallyframe.operators.predicates import filter_rows
from tallyframe.operators.profile import summary
from tallyframe.operators.reconcile import reconcile
from tallyframe.sources.readers import read_table


def test_number_keys(spark):
    same = [["1200", " 01200.0", "1.2e3", "+1200", "12E+2"], ["0", "-0.0", ".0", "0e9"], ["-0.05", "-5e-2", "-.050"], ["1" * 50], ["1" * 49 + "2"], ["1e400"]]
    rows = [(i, t) for i, ts in enumerate(same) for t in ts] + [(None, t) for t in ("", "x", ".", "1e", "--1")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", number_key(F.col("t")).alias("k")).collect()
    assert {r["k"] for r in got if r["i"] is None} == {None}
    groups = {}
    for r in got:
        if r["i"] is not None:
            groups.setdefault(r["i"], set()).add(r["k"])
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(same)


def test_distinct_fractions(spark):
    df = spark.createDataFrame([(0.0001234567890123456, 0.0), (0.0001234567890123457, -0.0), (None, float("nan"))], "a double, b double")
    assert {r["column"]: r["distinct"] for r in summary(df).collect()} == {"a": 2, "b": 1}


def test_keys_of_two_types(spark):
    big = spark.createDataFrame([(2**53 + 1,), (2**53,), (5,)], "k long")
    half = spark.createDataFrame([(float(2**53), "a"), (5.0, "b"), (5.5, "c")], "h double, v string")
    assert sorted(r["v"] for r in merge(big, half, [{"left": "k", "right": "h"}]).collect()) == ["a", "b"]
    long = spark.createDataFrame([("9" * 40 + "1",), ("9" * 40 + "2",)], "k string")
    other = spark.createDataFrame([("9" * 40 + "1.00", "x")], "h string, v string")
    assert merge(long, other, [{"left": "k", "right": "h"}], keys_as="loose").count() == 1


def test_pivot_headers(spark):
    df = spark.createDataFrame([("r", "a", 1), ("r", "A", 2), (None, "b", 3), ("s", "a", 4)], "k string, h string, v int")
    made = pivot(df, "k", "h", [{"column": "v", "aggregation": "sum"}, {"column": "v", "aggregation": "count"}])
    assert made.columns == ["k", "v:sum|A", "v:sum|a", "v:count|A", "v:count|a"]
    assert {tuple(r)[:3] for r in made.collect()} == {("r", 2, 1), ("s", None, 4)} or {tuple(r)[:3] for r in made.collect()} == {("r", 2, 1), ("s", 0, 4)}


def test_first_needs_no_order(spark):
    df = spark.createDataFrame([("k", i % 7, f"v{i}") for i in range(200)], "k string, n int, v string").repartition(9)
    one = lambda d: tuple(group_aggregate(d, "k", [{"column": "v", "aggregation": "first"}, {"column": "n", "aggregation": "last"}]).first())
    assert one(df) == one(df.repartition(3)) == one(df.orderBy(F.rand(1)))


def test_long_bounds(spark):
    df = spark.range(3)
    assert filter_rows(df, [{"column": "id", "operator": "less_than", "value": "9" * 400}]).count() == 3


def test_reconciled_again(spark):
    left = spark.createDataFrame([(1, "x", 5.0), (2, "y", 6.0)], "k long, tag string, v double")
    right = spark.createDataFrame([(1, "p", 5.0), (3, "q", 7.0)], "k long, tag string, v double")
    spec = {"keys": [{"left": "k", "right": "k", "criteria": "exact"}], "values": [{"left": "v", "right": "v"}], "settings": {"method": "one-to-one"}, "cross_reference": {"left": ["tag"], "right": ["tag"]}}
    once, _ = reconcile(left, right, **spec)
    again, other = reconcile(once, right, **spec)
    for df in (again, other):
        assert len({c.lower() for c in df.columns}) == len(df.columns)
    assert again.count() == 2


@pytest.fixture
def small_splits(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "300"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def test_line_breaks_in_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    cells = ["plain", "two\nlines", 'quo"te', "a,b", "c\r\nd", "x" * 700 + "\n\n" + "y" * 700, "", '"\n"', "é\n"]
    rows = [(i, rng.choice(cells), i / 2) for i in range(120)]
    for k in range(2):
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["id", "no te", "v"])
            out.writerows(rows[k * 60 : k * 60 + 60])
    want = sorted((i, t or None, v) for i, t, v in rows)
    df = read_table(spark, str(tmp_path), "csv")
    assert df.columns == ["id", "no te", "v"] and isinstance(df.schema["id"].dataType, T.IntegerType)
    assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, read_table(spark, str(tmp_path), "csv", schema="a long, b string, c double").collect())) == want
    (tmp_path / "9.csv").write_text('id,no te,v\n1,"open\n')
    with pytest.raises(ValueError, match="still open at the end of"):
        read_table(spark, str(tmp_path), "csv")


def test_own_helper_like_names(spark):
    left = spark.createDataFrame([(1, "x", 5.0, 7), (2, "y", 6.0, 8)], "k long, __tag string, __x double, __t int")
    right = spark.createDataFrame([(1, 5.0, "p"), (3, 7.0, "q")], "k long, v double, __k0 string")
    spec = {"keys": [{"left": "k", "right": "k", "criteria": "exact"}], "values": [{"left": "__x", "right": "v"}], "settings": {"method": "one-to-one"}, "cross_reference": {"left": ["__tag"], "right": ["__k0"]}}
    one, two = reconcile(left, right, **spec)
    assert one.columns[:4] == left.columns and two.columns[:3] == right.columns
    assert sorted((r["k"], r["__tag"], r["__t"], r["__k0"]) for r in one.collect()) == [(1, "x", 7, "p"), (2, "y", 8, None)]
    with pytest.raises(ValueError, match="cannot begin"):
        reconcile(left.withColumn("__reco:t", F.lit(1)), right, **spec)
