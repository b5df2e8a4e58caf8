"""Columns beside the text come out of the Python stages as they went in."""

import datetime as dt

from tallyframe.llm import licenses, line_dedup, near_copies, outliers, pieces, pii, toxicity
from tallyframe.llm.words import STEP_TEXTS, steps

BIG = 2**53 + 1


def test_values_beside_the_text(spark):
    far = dt.datetime(9999, 12, 31, 23, 59, 59)
    rows = [(BIG, "mail a.b@example.org now", far, None, "x"), (None, None, None, BIG, "y"), (BIG + 2, "fine words", far, BIG, None)]
    docs = spark.createDataFrame(rows, "c1 long, c0 string, t timestamp_ntz, n long, C0_ string").coalesce(1)
    labels = spark.createDataFrame([(BIG, 0)], "c1 long, toxic int")
    masked = pii.mask_personal_data(docs, doc_id="c1", text="c0").collect()
    assert [r["c1"] for r in masked] == [BIG, None, BIG + 2] and [r["n"] for r in masked] == [None, BIG, BIG]
    assert [r["c0"] for r in masked] == ["mail [EMAIL] now", None, "fine words"] and masked[0]["t"] == far
    kept = toxicity.drop_toxic(docs, labels.withColumnRenamed("c1", "doc_id").toDF("c1", "toxic"), doc_id="c1", text="c0").collect()
    assert sorted(r["c1"] or 0 for r in kept) == [0, BIG, BIG + 2] and {r["t"] for r in kept} == {far, None}


def test_large_ids_beside_a_null_one(spark):
    ids = [BIG, None, BIG + 2]
    docs = spark.createDataFrame([(i, "some plain words of a text", "en", "s") for i in ids], "doc_id long, text string, lang string, source string").coalesce(1)
    labels = spark.createDataFrame([(BIG, 0)], "doc_id long, toxic int")
    found = {
        "outliers": outliers.reject_outliers(docs), "licenses": licenses.scan_licenses(docs), "personal data": pii.find_personal_data(docs),
        "pieces": pieces.encode_documents(docs), "toxicity": toxicity.score_toxicity(docs, labels), "near copies": near_copies.near_copies(docs),
    }
    for name, out in found.items():
        assert dict(out.dtypes)["doc_id"] == "bigint", name
        assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, BIG, BIG + 2], name


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "x y"), (None, "x y"), ("007", None)], "doc_id string, text string").coalesce(1)
    for out in (licenses.scan_licenses(docs), pii.find_personal_data(docs)):
        assert {r["doc_id"] for r in out.collect()} == {"a", None, "007"}


def test_steps_bound_their_texts():
    texts = [""] * (STEP_TEXTS + 3) + ["ab"] * STEP_TEXTS
    found = list(steps(texts))
    assert max(s.stop - s.start for s in found) <= STEP_TEXTS
    assert [i for s in found for i in range(s.start, s.stop)] == list(range(len(texts)))


def test_a_text_with_many_lines_keeps_the_others(spark):
    own = [f"line number {i} of a long text, {i * 7919}" for i in range(3000)]
    own = [w + "".join(chr(97 + (i * k) % 26) for k in range(1, 40)) for i, w in enumerate(own)]
    docs = spark.createDataFrame([(1, own[5]), (2, "\n".join([*own, own[7], ""])), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, edits=1).collect()}
    kept = rows[2]["text"].split("\n")
    assert rows[2]["n_lines"] == 3002 and rows[2]["n_removed"] == 3002 - len(kept) and kept[-1] == ""
    assert own[5] not in kept and kept.count(own[7]) == 1 and rows[3]["n_lines"] == 1
