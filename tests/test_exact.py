"""Values and rows that must come through whole: long keys, long texts, quoted cells, tied pages."""

import numpy as np
import pandas as pd

from tallyframe.functions.similarity import TextSet, score_pairs
from tallyframe.operators.predicates import filter_rows
from tallyframe.operators.sorting import page
from tallyframe.operators.typing import coerce_types
from tallyframe.sources.readers import read_table
from tallyframe.sources.writers import write_table


def test_long_texts_are_scored_by_all_characters():
    t = np.array(["a" * 70_000], dtype=object)
    a = TextSet(t)
    assert int(a.bins.max()) == 70_000
    short = TextSet(np.array(["abc" * 50], dtype=object))
    scores, at = score_pairs(short, short, np.array([0]), np.array([0]), 0.85)
    assert scores.tolist() == [1.0] and at.tolist() == [0]


def test_bounds_beyond_doubles(spark, tmp_path):
    keys = [9007199254740992, 9007199254740993, 3000000001]
    spark.createDataFrame([(k,) for k in keys], "k long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    one = filter_rows(df, [{"column": "k", "operator": "equals", "value": "9007199254740993"}])
    assert [r.k for r in one.collect()] == [9007199254740993]
    big = filter_rows(df, [{"column": "k", "operator": "greater_than", "value": "3000000000"}])
    assert "GreaterThan(k,3000000000)" in big._jdf.queryExecution().toString() and big.count() == 3


def test_whole_numbers_stay_whole(spark):
    df = spark.createDataFrame([(1, "9007199254740993"), (2, "12.7"), (3, "12.0"), (4, "x"), (5, " 7 "), (6, "1e3")], "i int, v string")
    assert [r.v for r in coerce_types(df, {"v": "integer"}).orderBy("i").collect()] == [9007199254740993, None, 12, None, 7, 1000]


def test_quoted_cells_survive(spark, tmp_path):
    rows = [(1, 'he said "hi", ok'), (2, "plain, comma"), (3, None), (4, 'back\\slash "q"'), (5, "two\nlines")]
    df = spark.createDataFrame(rows, "id int, v string")
    write_table(df.coalesce(1), str(tmp_path / "c"), "csv")
    back = read_table(spark, str(tmp_path / "c"), "csv", schema="id int, v string", line_breaks=True)
    assert sorted(tuple(r) for r in back.collect()) == rows
    other = pd.concat([pd.read_csv(f) for f in (tmp_path / "c").glob("*.csv")])
    assert sorted(other.id) == [1, 2, 3, 4, 5] and other.set_index("id").v[1] == rows[0][1] and other.set_index("id").v[5] == rows[4][1]


def test_pages_of_ties_make_up_the_table(spark, limits):
    df = spark.range(100).selectExpr("id", "id % 3 as k").repartition(7)
    with limits(pageTakeRows=40):
        seen = [r.id for n in range(1, 11) for r in page(df, [{"column": "k", "order": "asc"}], n, 10).collect()]
        assert sorted(seen) == list(range(100))
        assert [r.id for r in page(df, [{"column": "k", "order": "asc"}], 99, 10).collect()] == seen[-10:]
