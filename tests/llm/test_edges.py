"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import licenses, line_dedup, near_copies, outliers, packing, pieces, pii, secrets, top_k, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, node string, key string, t string, row string, n long, rest string"
LINE = "This line is long enough to be compared with other lines."


def _row(i, text, lang="en", source="s"):
    return (i, text, lang, source, "x", "y", "z", "w", 7, "r")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [_row(1, None), _row(2, ""), _row(3, " \n\t"), _row(None, "no id here"), _row(5, "word " * 30000), _row(6, LINE + "\nmore"), _row(6, LINE + "\nmore"),
            _row(7, "tie " + LINE, None, None), _row(8, "x" * 50000), _row(9, "naïve 😀 text\r\nwith lines")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("1 = 0").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (9, 0)], "doc_id long, toxic int")


def _run(name, docs, labels):
    run = {
        "outliers": lambda: outliers.reject_outliers(docs), "lines": lambda: line_dedup.dedup_lines(docs), "packing": lambda: packing.pack(docs, context=1000, budget=5000, buckets=3),
        "licenses": lambda: licenses.scan_licenses(docs), "pii": lambda: pii.find_personal_data(docs), "secrets": lambda: secrets.find_secrets(docs), "pieces": lambda: pieces.encode_documents(docs),
        "toxicity": lambda: toxicity.score_toxicity(docs, labels), "copies": lambda: near_copies.near_copies(docs),
    }
    return run[name]()


NAMES = ["outliers", "lines", "licenses", "pii", "secrets", "pieces", "toxicity", "copies", "packing"]


@pytest.mark.parametrize("name", NAMES)
def test_edges(docs, labels, name):
    rows = _run(name, docs, labels).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r.asDict())
    assert set(by) == {1, 2, 3, None, 5, 6, 7, 8, 9}
    if name == "packing":
        assert sorted(r["n_tokens"] for r in by[5]) == [1000] * 30
        assert by[1][0]["batch"] is None and by[2][0]["n_tokens"] == 0
    else:
        assert len(rows) == 10 and by[6][0] == by[6][1]
    if name == "outliers":
        assert by[1][0]["n_words"] == 0 and by[1][0]["base_failed"] and not by[1][0]["kept"]
    if name == "pii":
        assert by[1][0]["spans"] == "" and by[2][0]["base_sha256"] == by[1][0]["base_sha256"]
    if name == "copies":
        assert by[6][0]["class_id"] == 6 and by[6][0]["class_size"] == 2 and by[2][0]["class_id"] == 2
    if name == "toxicity":
        assert by[1][0]["score"] == by[2][0]["score"] < 0.3
    if name == "pieces":
        assert all(r["decoded"] for r in rows) and by[1][0]["n_pieces"] == 0 and by[1][0]["losses"] == [0.0]
    if name == "lines":
        assert by[1][0]["text"] is None and by[1][0]["n_lines"] == 0 and by[6][0]["text"] == LINE + "\nmore" and by[7][0]["node"] == "x"


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(none, labels, name):
    assert _run(name, none, labels.filter("1 = 0")).count() == 0


def test_drops_keep_columns(docs, labels):
    for out in (near_copies.drop_near_copies(docs), toxicity.drop_toxic(docs, labels), pii.mask_personal_data(docs)):
        assert out.columns == docs.columns
    kept = near_copies.drop_near_copies(docs)
    assert kept.filter("doc_id = 6").count() == 1 and kept.filter(F.trim(F.translate(F.coalesce("text", F.lit("")), "\n\t", "")) == "").count() == 3
    assert pii.mask_personal_data(docs).count() == 10 and toxicity.drop_toxic(docs, labels).filter(F.col("doc_id").isNull()).count() == 1


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (100, [float("inf"), 0.0]), (200, [1e9, 1e9])],
                              "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k.top_k(v, k=2).orderBy("query_id", "rank").collect()]
    assert got[:2] == [(0, 1, 200, 1024 * 1024 * 10**9 + 512 * 1024 * 10**9), (0, 2, 1, 1024 * 512 + 512 * 512)]
    assert [g[:3] for g in got[2:]] == [(200, 1, 0), (200, 2, 0)]
    assert top_k.top_k(v.filter("1 = 0")).count() == 0


def test_a_pair_that_shares_several_buckets_is_one_row(spark):
    """Texts apart that agree in all bands, or in bands 2 and 3 only, meet once; the pairs are those of all buckets."""
    low = bytes(range(8))
    rows = [(bytes([n]), low, keys) for n, keys in [(1, [10, 20, 30]), (2, [10, 20, 30]), (3, [11, 20, 30]), (4, [12, 21, 30])]]
    signatures = spark.createDataFrame(rows, "node binary, low binary, keys array<long>")
    apart = signatures.select(F.explode("keys").alias("key"), "node", F.col("node").alias("root"))
    got = [(bytes(r.a), bytes(r.b)) for r in near_copies.crossing(apart, signatures, 8, 0.8, 5, False).collect()]
    assert sorted(got) == [(bytes([a]), bytes([b])) for a in range(1, 5) for b in range(a + 1, 5)]
