"""Joins, unions, groups, pivots, profiles, typing, sources."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import clean, conformance, grouping, joins, profile, sorting, typing, unions
from tallyframe.operators.numbering import number_rows, number_within
from tallyframe.sources import readers, writers


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (3, "d")], "k int, v string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, "x"), (None, "y"), (None, "z"), (4, "w")], "k int, v string")


PAIR = [{"left": "k", "right": "k"}]


def test_null_keys_match_and_names_get_suffixes(left, right, rows):
    inner = joins.merge(left, right, PAIR, "inner")
    assert inner.columns == ["k", "v_left", "v_right"]
    assert rows(inner) == [(None, "c", "y"), (None, "c", "z"), (1, "a", "x"), (1, "b", "x")]
    assert rows(joins.merge(left, right, PAIR, "outer")) == [
        (None, "c", "y"), (None, "c", "z"), (1, "a", "x"), (1, "b", "x"), (3, "d", None), (4, None, "w")]


@pytest.mark.parametrize("method", joins.METHODS)
def test_summary_adds_up_to_the_rows(left, right, method):
    counts = {r["match"]: r["count"] for r in joins.match_summary(left, right, PAIR, method).collect()}
    assert set(counts) == set(joins.CLASSES)
    assert sum(counts.values()) == joins.merge(left, right, PAIR, method).count()


@pytest.mark.parametrize("method", ["inner", "left", "right", "outer"])
def test_a_crowded_key_is_dealt_to_many_tasks(spark, limits, rows, method):
    """Copies of one row too, and keys whose longer side is the right one."""
    many = spark.createDataFrame([(None, "n")] * 40 + [(1, f"a{i}") for i in range(3)] + [(2, "b"), (5, "c")], "k int, v string")
    other = spark.createDataFrame([(None, "x"), (None, "x"), (2, "y"), (4, "z")] + [(1, f"w{i}") for i in range(30)], "k int, v string")
    for a, b in [(many, other), (other, many)]:
        whole = rows(joins.merge(a, b, PAIR, method))
        with limits(mergePairs=10):
            dealt = joins.merge(a, b, PAIR, method)
            assert rows(dealt) == whole
            made = dealt.filter("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert len(made) > 1 and max(r["count"] for r in made) < 80


def test_few_copies_of_the_rows_of_crowded_keys(spark, limits, rows, monkeypatch):
    """Crowded keys smaller than a share of all pairs are not copied, a large one by the square root of its cells."""
    def pairs_of(keys, rows_per_key):
        both = [spark.range(keys * rows_per_key).select((F.col("id") % keys).alias("k"), F.col("id").alias(v)) for v in ("v", "w")]
        copies.clear()
        with limits(mergePairs=10):
            merged = joins.merge(*both, PAIR, "outer")
            # The copies are shuffled once.
            plan = merged._jdf.queryExecution().executedPlan().toString()
        assert rows(merged) == sorted((k, v, w) for k in range(keys) for v in range(k, keys * rows_per_key, keys) for w in range(k, keys * rows_per_key, keys))
        return [df.count() for df in copies], plan

    copies, dealt = [], joins._dealt
    monkeypatch.setattr(joins, "_dealt", lambda *args: copies.append(dealt(*args)) or copies[-1])
    assert pairs_of(40, 20)[0] == [800, 800]
    counts, plan = pairs_of(1, 100)
    assert counts == [200, 200]
    assert plan.count("Exchange hashpartitioning(__lid") == plan.count("Exchange hashpartitioning(__rid") == 1


def test_different_key_names_both_stay(left, spark):
    other = spark.createDataFrame([("1", 5)], "key string, n int")
    merged = joins.merge(left, other, [{"left": "k", "right": "key"}], "inner")
    assert merged.columns == ["k", "v", "key", "n"]
    assert merged.count() == 2
    assert joins.merge_preview(left, other, {"left": "k", "right": "key"}).columns == merged.columns
    assert joins.keys_in_class(left, other, [{"left": "k", "right": "key"}], "left_only").count() == 2


def test_merge_errors(left, right):
    for pairs, how in (([], "inner"), ([{"left": "k"}], "inner"), (PAIR, "cross"), ([{"left": "q", "right": "k"}], "inner")):
        with pytest.raises(ValueError):
            joins.merge(left, right, pairs, how)


def test_unions(spark, left):
    other = spark.createDataFrame([("p", 2.5, True)], "v string, k double, extra boolean")
    assert unions.union_common(left, other).dtypes == [("k", "double"), ("v", "string")]
    assert unions.dropped_columns(left, other) == {"table1": [], "table2": ["extra"]}
    with pytest.raises(ValueError):
        unions.union_strict(left, other)
    with pytest.raises(ValueError):
        unions.union_common(left, spark.createDataFrame([(1,)], "zzz int"))
    assert unions.union_all_columns([left, other]).columns == ["k", "v", "extra"]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [("r1", "h1", 1.0, 1), ("r1", "h2", None, 2), ("r2", "h1", 5.0, 3), ("r2", None, 7.0, 4), (None, "h1", 9.0, 5), ("r2", "h1", 3.0, 6)],
        "row string, head string, v double, at int",
    )


def test_group_null_rules(gaps, rows):
    made = grouping.group_aggregate(gaps, "row", [{"column": "v", "aggregation": "sum"}])
    assert rows(made) == [("r1", 1.0), ("r2", 15.0)]
    none = grouping.group_aggregate(gaps.filter("head = 'h2'"), "row", [{"column": "v", "aggregation": "sum"}])
    assert rows(none) == [("r1", 0.0)]
    assert grouping.group_aggregate(gaps.filter("head = 'h2'"), "row", [{"column": "v", "aggregation": "mean"}]).count() == 0
    first_last = grouping.group_aggregate(gaps, "row", [
        {"column": "v", "aggregation": "first"}, {"column": "v", "aggregation": "last"}], order_by=["at"])
    assert first_last.columns == ["row", "v:first", "v:last"]
    assert rows(first_last) == [("r1", 1.0, 1.0), ("r2", 5.0, 3.0)]


def test_pivot(gaps, rows):
    made = grouping.pivot(gaps, "row", "head", [{"column": "v", "aggregation": "sum"}, {"column": "at", "aggregation": "max"}])
    assert made.columns == ["row", "v|h1", "v|h2", "at|h1", "at|h2"]
    assert rows(made) == [("r1", 1.0, 0.0, 1, 2), ("r2", 8.0, None, 6, None)]
    given = grouping.pivot(gaps, "row", "head", [{"column": "v", "aggregation": "sum"}], headers=["h2"])
    assert given.columns == ["row", "v|h2"]
    numbers = grouping.pivot(gaps.withColumn("n", F.col("at") * 5), "row", ["n"], [{"column": "v", "aggregation": "max"}])
    assert numbers.columns == ["row"] + [f"v|{n}" for n in (5, 10, 15, 20, 30)]  # sorted as numbers; 25 has no row key


def test_pivot_width_is_checked(gaps, limits):
    with limits(pivotMaxColumns=1), pytest.raises(ValueError, match="pivotMaxColumns"):
        grouping.pivot(gaps, "row", "head", [{"column": "v", "aggregation": "sum"}])


def test_text_guard_sees_the_whole_table(gaps):
    with pytest.raises(ValueError, match="text column"):
        grouping.pivot(gaps, "row", None, [{"column": "head", "aggregation": "mean"}])
    fallback = grouping.group_aggregate(gaps, "row", [{"column": "head", "aggregation": "sum"}], ["at"], text_sum="first")
    assert {tuple(r) for r in fallback.collect()} == {("r1", "h1"), ("r2", "h1")}


def test_median_of_a_hot_group(spark, limits, rows):
    data = [("hot", float(i % 7)) for i in range(101)] + [("hot2", float(i)) for i in range(60)] + [("cold", 1.0), ("cold", 4.0), ("cold", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    want = rows(grouping.group_aggregate(df, "k", [{"column": "v", "aggregation": "median"}, {"column": "v", "aggregation": "count"}]))
    with limits(hotGroupRows=20):
        got = rows(grouping.group_aggregate(df, "k", [{"column": "v", "aggregation": "median"}, {"column": "v", "aggregation": "count"}]))
        assert got == want == [("cold", 2.5, 2), ("hot", 3.0, 101), ("hot2", 29.5, 60)]
        whole = grouping.group_aggregate(df, [], [{"column": "v", "aggregation": "median"}]).first()[0]
    assert whole == sorted(v for _, v in data if v is not None)[81]  # 163 values


def test_numbers_within_hot_groups(spark, limits, rows):
    data = [("hot", i % 50, i) for i in range(300)] + [("cold", 3, 1), ("cold", 1, 2), (None, 5, 5)]
    df = spark.createDataFrame(data, "k string, o int, id int").repartition(6)
    order = [F.col("o").desc(), F.col("id")]
    want = rows(number_within(df, ["k"], order, "n"))
    with limits(hotGroupRows=40):
        assert rows(number_within(df, ["k"], order, "n")) == want
    assert [r.n for r in number_rows(df, [F.col("id"), F.col("k")], "n").orderBy("n").collect()] == list(range(1, 304))


def test_copies_of_one_row_are_numbered_apart(spark, limits):
    df = spark.createDataFrame([("hot", 1)] * 200, "k string, o int").repartition(4)
    with limits(hotGroupRows=40):
        assert sorted(r.n for r in number_within(df, ["k"], [F.col("o")], "n").collect()) == list(range(1, 201))


def test_sort_and_pages(spark, limits):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(30)], "id int, v int")
    for way in ("asc", "desc"):
        assert [r.v for r in sorting.sort_rows(df, [{"column": "v", "order": way}]).collect()][-10:] == [None] * 10
    keys = [{"column": "v", "order": "desc"}, {"column": "id", "order": "asc"}]
    near = [[r.id for r in sorting.page(df, keys, p, 7).collect()] for p in (0, 1, 3, 5)]
    with limits(pageTakeRows=1):
        deep = [[r.id for r in sorting.page(df, keys, p, 7).collect()] for p in (0, 1, 3, 5)]
    assert near == deep and near[0] == near[1] and len(near[3]) == 2
    assert tuple(sorting.page_info(df, 7).first()) == (30, 5)
    assert sorting.clamp_page(9, 30, 7) == 5 and sorting.clamp_page(0, 0, 7) == 1


def test_value_types(spark, rows):
    df = spark.createDataFrame(
        [("Yes", f"2020-01-{i + 1:02d}" if i < 7 else "x", f"2020-01-{i + 1:02d}", f"202001{i + 1:02d}", str(i), f"{i}.5", "a", None, i % 2, 1.0 * i)
         for i in range(10)],
        "bool_text string, at_70 string, iso string, digits string, whole string, part string, free string, void string, flag int, f double")
    assert dict(rows(profile.logical_types(df))) == {
        "bool_text": "boolean", "at_70": "string", "iso": "date", "digits": "date", "whole": "integer", "part": "float",
        "free": "string", "void": "string", "flag": "boolean", "f": "integer"}
    mixed = dict(rows(profile.mixed_types(df)))
    assert mixed["bool_text"] == "string" and mixed["flag"] == "integer" and mixed["f"] == "float"
    assert profile.storage_types(df)["flag"] == "integer"
    empty = df.limit(0)
    assert set(dict(rows(profile.logical_types(empty))).values()) == {"string"}


def test_summary(spark, rows):
    df = spark.createDataFrame([(1, "a", float("nan")), (1, None, 2.0), (2, "b", 2.0)], "i int, s string, f double")
    want = [("f", 3, 1, 1), ("i", 3, 0, 2), ("s", 3, 1, 2)]
    assert rows(profile.summary(df)) == want
    assert rows(profile.summary(df, approximate=True)) == want


def test_dates(spark, rows):
    raw = ["2020", "202-bad", "20231201", "2020-05", "31/12/2020", None, "20231399", " 2019-03-04 "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "id int, d string")
    parsed = typing.coerce_types(df, {"d": "datetime"}, {"d": "DD/MM/YYYY"})
    assert [r.d for r in parsed.orderBy("id").collect()] == [
        date(2020, 1, 1), None, date(2023, 12, 1), date(2020, 5, 1), date(2020, 12, 31), None, None, date(2019, 3, 4)]
    with pytest.raises(ValueError, match="202-bad"):
        typing.strict_types(df, None, {"d": "datetime"})
    assert typing.inferred_date_format(df.filter("d like '%/%'"), "d") == "DD/MM/YYYY"
    assert typing.inferred_date_format(df, "d") == "YYYY-MM-DD"


def test_strict_typing(spark):
    df = spark.createDataFrame([("1", "1.5", "x", 1.0), ("2", None, "y", 2.0)], "a string, b string, c string, d double")
    typed = typing.strict_types(df, {"c": True, "a": True, "b": True, "d": True})
    assert typed.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "bigint")]
    with pytest.raises(ValueError, match="cannot convert column 'c' to integer: x, y"):
        typing.strict_types(df, ["c"], {"c": "integer"})
    with pytest.raises(Exception, match="cannot convert column"):
        typing.strict_types(df, ["c"], {"c": "integer"}, check=False).collect()
    with pytest.raises(ValueError, match="no columns"):
        typing.strict_types(df, {"a": False})
    done, report = typing.type_tables({"t": df}, [{"tableName": "t", "columnTypes": {"a": "float"}}, {"tableName": "gone"}])
    assert done["t"].dtypes[0] == ("a", "double") and [r["success"] for r in report] == [True, False]


def test_cleaning(spark, rows):
    df = spark.createDataFrame([(1, None, None, None, float("inf")), (None, "x", datetime(2020, 1, 1), None, float("nan"))],
                               "i int, s string, t timestamp_ntz, `Unnamed: 1` int, f double")
    filled = clean.fill_blanks(df.select("i", "s", "t")).collect()
    assert [tuple(r) for r in filled] == [(1, "", datetime(1900, 1, 1)), (0, "x", datetime(2020, 1, 1))]
    assert clean.drop_empty_columns(df).columns == ["i", "s", "t", "f"]
    assert [r.f for r in clean.infinite_to_null(df).collect()] == [None, None]
    assert [r.f for r in clean.nan_to_null(df).collect()] == [float("inf"), None]
    assert rows(clean.fill_literal(df.select("i", "s"))) == [("-", "x"), ("1", "-")]


def test_conformance(spark, left, right):
    other = spark.createDataFrame([(1, 2, 3)], "k string, w int, v int")
    assert conformance.conforms(left, right)
    assert [(p["column"], p["status"]) for p in conformance.problems(left, other)] == [
        ("k", "type mismatch"), ("v", "type mismatch"), ("w", "extra")]
    assert conformance.conforms({"k": "string"}, other, allow_extra=True) and not conformance.conforms({"k": "string"}, other)
    assert conformance.exact(left, right).count() == 2 and conformance.superset({"k": "string"}, other).count() == 1


def test_sources_and_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, "NA" if i == 0 else f"n{i}", i / 2) for i in range(25)], "id int, `my name` string, x double")
    base = str(tmp_path)
    writers.write_table(df, f"{base}/t.csv", "csv")
    back = readers.read_table(spark, f"{base}/t.csv", null_tokens=readers.NULL_TOKENS)
    assert back.dtypes == [("id", "int"), ("my name", "string"), ("x", "double")]
    assert back.filter("`my name` is null").count() == 1
    typed = readers.read_table(spark, f"{base}/t.csv", schema="id long, `my name` string, x string", columns=["x", "id"])
    assert typed.dtypes == [("x", "string"), ("id", "bigint")]
    for fmt in ("json", "orc", "parquet"):
        writers.convert(spark, f"{base}/t.csv", f"{base}/t.{fmt}")
        assert readers.read_table(spark, f"{base}/t.{fmt}").count() == 25
    assert readers.read_sample(spark, f"{base}/t.parquet", 10).count() == 10
    stacked = readers.read_stacked(spark, [f"{base}/t.parquet", f"{base}/t.orc"])
    assert stacked.count() == 50
    writers.write_parts(df.coalesce(1), f"{base}/parts", writers.part_counts(df, 10), "csv", 10)
    assert len(list((tmp_path / "parts").glob("*.csv"))) == 3
    assert spark.read.csv(f"{base}/parts_summary", header=True).first()["parts"] == "3"
    table, about = readers.register_table(df, "kept", base)
    assert spark.table("kept").count() == 25 and table.count() == 25
    assert dict((r.column, r.type) for r in about.collect()) == {"id": "integer", "my name": "string", "x": "float"}
    assert len(spark.read.json(f"{base}/kept.profile").collect()) == 3
    writers.write_pair((df, df.limit(3)), (f"{base}/l", f"{base}/r"))
    assert spark.read.parquet(f"{base}/r").count() == 3
    assert rows(writers.counted({"a": df, "b": df.limit(1)})) == [("a", 25), ("b", 1)]
    with pytest.raises(ValueError):
        readers.format_of("table.xlsx")
