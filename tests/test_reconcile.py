"""Pairing against plain greedy code, on ordinary and on hot blocks; tolerances and checks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.similarity import TextSet, jaro_winkler_scores, score_pairs, signatures
from tallyframe.operators import fuzzy, nearest
from tallyframe.operators.fuzzy import _scored_blocks, fuzzy_join, scored_texts
from tallyframe.operators.reconcile import block_sizes, check_spec, reconcile, statistics

KEY = [{"left": "k", "right": "k"}]
VALUE = [{"left": "amt", "right": "amt"}]


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, name string, amt double, day double")


def pairs_of(left_out):
    """(left id, right id) of the matched rows."""
    return {(r["id"], r["id-2"]) for r in left_out.collect() if r["Reco_Status"]}


def greedy(base, others, rank):
    """Take, base row by base row, the best free partner of the block."""
    free, found = list(others), set()
    for b in base:
        choices = [(rank(b, o), i) for i, o in enumerate(free) if o[0] == b[0] and rank(b, o) is not None]
        if choices:
            o = free.pop(min(choices)[1])
            found.add((b[1], o[1]))
    return found


def make(seed, blocks, n, names=("jon smith", "john smith", "jon smyth", "mary", "marie", "bob")):
    rng = random.Random(seed)
    rows = [(rng.choice(blocks), i, rng.choice(names), float(rng.randint(0, 9)), float(rng.randint(0, 25))) for i in range(n)]
    return rows


def run(spark, left, right, how, base="left", keys=KEY, refs=("id",)):
    return reconcile(
        table(spark, left), table(spark, right), keys, VALUE,
        {"duplicate": how, "basis_table": base, "basis_column": {"left": "day", "right": "day"}},
        {"left": list(refs), "right": list(refs)}, order_by={"left": ["id"], "right": ["id"]},
    )


NEAR = {
    "closest": lambda d: (abs(d), d < 0),
    "immediately_before": lambda d: (d, False) if d >= 0 else None,
    "immediately_after": lambda d: (-d, False) if d <= 0 else None,
}


def near_rank(how):
    def rank(b, o):
        found = NEAR[how](b[4] - o[4])
        return None if found is None else (*found, o[1])
    return rank


HOT = {"hotGroupRows": 10, "chunkRows": 8, "visitorRows": 12}


@pytest.mark.parametrize("hot", [False, True])
def test_row_order_pairing(spark, limits, hot):
    left, right = make(1, "aab", 60), make(2, "abb", 50)
    want = greedy(left, right, lambda b, o: o[1])
    with limits(**(HOT if hot else {})):
        a, b = reconcile(table(spark, left), table(spark, right), KEY, VALUE, {}, {"left": ["id"], "right": ["id"]},
                         order_by={"left": ["id"], "right": ["id"]})
        assert pairs_of(a) == want
        assert {(r["id-1"], r["id"]) for r in b.collect() if r["Reco_Status"]} == want
        assert a.count() == 60 and b.count() == 50
        stats = {r.side: (r.matched, r.unmatched) for r in statistics(a, b).collect()}
    assert stats == {"left": (len(want), 60 - len(want)), "right": (len(want), 50 - len(want))}


def test_first_occurrence_follows_the_partner_basis(spark):
    left, right = make(3, "ab", 20), make(4, "ab", 20)
    want = greedy(left, right, lambda b, o: (o[4], o[1]))
    assert pairs_of(run(spark, left, right, "first_occurrence")[0]) == want


@pytest.mark.parametrize(("how", "hot"), [(h, False) for h in NEAR] + [("closest", True), ("immediately_before", True), ("immediately_after", True)])
def test_nearest_pairing(spark, limits, how, hot):
    left, right = make(5, "aaab", 36), make(6, "aaab", 34)
    with limits(**(HOT if hot else {})):
        a, b = run(spark, left, right, how)
        assert pairs_of(a) == greedy(left, right, near_rank(how))
        assert b.filter("Reco_Status is not null").count() == a.filter("Reco_Status is not null").count()


def test_nearest_from_the_right(spark):
    left, right = make(7, "ab", 30), make(8, "ab", 30)
    a, _ = run(spark, left, right, "closest", "right")
    want = greedy(right, left, near_rank("closest"))
    assert pairs_of(a) == {(o, b) for b, o in want}


def test_settle_matches_plain_greedy():
    rng = random.Random(9)
    for _ in range(400):
        mode = rng.choice([nearest.CLOSEST, nearest.BEFORE, nearest.AFTER])
        span = rng.choice([3, 10, 60])
        spots = sorted(float(rng.randint(0, span)) for _ in range(rng.randint(1, 12)))
        xs = [float(rng.randint(0, span)) for _ in range(rng.randint(1, 12))]
        free, want = list(spots), []
        for x in xs:
            choices = [(NEAR[mode](x - p), p) for p in free if NEAR[mode](x - p) is not None]
            want.append(min(choices)[1] if choices else None)
            if choices:
                free.remove(want[-1])
        places, room = np.unique(spots, return_counts=True)
        x = np.array(xs)
        lb, rb = nearest._first_bounds(x, mode)
        lc, rc = np.full(len(x), -1 if mode == nearest.AFTER else 0), np.full(len(x), -1 if mode == nearest.BEFORE else 0)
        taken = nearest.settle(places, room, x, 0, lc, lb, rc, rb)[0]
        assert [places[t] if t >= 0 else None for t in taken] == want


def fuzzy_rank(scores, how=None):
    def rank(b, o):
        s = scores[b[2], o[2]]
        near = (0, False) if how is None else NEAR[how](b[4] - o[4])
        return None if s < 0.85 or near is None else (-s, o[2], *near, o[1])
    return rank


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("how", ["first_occurrence", "closest", "immediately_before"])
def test_fuzzy_pairing(spark, limits, how, large):
    left, right = make(11, "ab", 24), make(12, "ab", 22)
    names = sorted({r[2] for r in left + right})
    grid = [(x, y) for x in names for y in names]
    scores = dict(zip(grid, jaro_winkler_scores(np.array([g[0] for g in grid], dtype=object), np.array([g[1] for g in grid], dtype=object))))
    keys = KEY + [{"left": "name", "right": "name", "criteria": "fuzzy"}]
    if how == "first_occurrence":
        def rank(b, o):
            found = fuzzy_rank(scores)(b, o)
            return found and (*found[:2], o[4], o[1])
    else:
        rank = fuzzy_rank(scores, how)
    with limits(**({"blockPairs": 20} if large else {})):
        a, _ = run(spark, left, right, how, keys=keys)
        assert pairs_of(a) == greedy(left, right, rank)


def test_every_similar_pair_shares_a_signature():
    rng = random.Random(13)

    def word():
        return "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 14)))

    words = [word() for _ in range(120)]
    words += [w[:i] + rng.choice("abx") + w[i + 1:] for w in words for i in [rng.randrange(len(w))]]
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(words)), np.arange(len(words)), indexing="ij"))
    texts = TextSet(np.array(words, dtype=object))
    all_scores, _ = score_pairs(texts, texts, i, j)
    for threshold in (0.6, 0.75, 0.85, 0.95):
        scores, kept = score_pairs(texts, texts, i, j, threshold)
        assert (kept == np.flatnonzero(all_scores >= threshold)).all() and (scores == all_scores[kept]).all()
        lefts = [set(signatures(w, threshold, True)) for w in words]
        rights = [set(signatures(w, threshold, False)) for w in words]
        assert all(lefts[i[k]] & rights[j[k]] for k in kept)


def test_scores_follow_the_definition():
    import duckdb

    rng = random.Random(14)
    pairs = [("".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))), "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for _ in range(500)]
    pairs += [("martha", "marhta"), ("dixon", "dicksonx"), ("x" * 300, "x" * 299 + "y")]
    got = jaro_winkler_scores(np.array([p[0] for p in pairs], dtype=object), np.array([p[1] for p in pairs], dtype=object))
    con = duckdb.connect()
    want = [con.execute("SELECT jaro_winkler_similarity(?, ?)", list(p)).fetchall()[0][0] for p in pairs]
    assert np.allclose(got, want, atol=1e-9)
    assert jaro_winkler_scores(np.array([""], dtype=object), np.array([""], dtype=object))[0] == 0


def test_signature_join_equals_block_scoring(spark, limits, rows):
    data = [("a" if i % 3 else "b", f"{w}{i % 17}") for i, w in enumerate(["alpha", "alpah", "beta", "betta", "gamma"] * 12)]
    left = spark.createDataFrame(data, "g string, a0 string")
    right = spark.createDataFrame([(g, t[::-1] if i % 4 == 0 else t) for i, (g, t) in enumerate(data)], "g string, b0 string")
    want = rows(scored_texts(left, right, 1))
    with limits(blockPairs=5):
        assert rows(scored_texts(left, right, 1)) == want


def test_two_fuzzy_keys(spark):
    left = spark.createDataFrame([("k", "jon smith", "paris"), ("k", "jon smith", "rome")], "k string, n string, c string")
    right = spark.createDataFrame([("k", "john smith", "pariss"), ("z", "jon smith", "paris")], "k string, n string, c string")
    joined = fuzzy_join(left, right, KEY, [{"left": "n", "right": "n"}, {"left": "c", "right": "c"}], ["c"], ["c"])
    assert [(r["left.c"], r["right.c"]) for r in joined.collect()] == [("paris", "pariss")]


def one(spark, a, b, **value):
    left, _ = reconcile(
        spark.createDataFrame([("x", a)], "k string, a double"), spark.createDataFrame([("x", b)], "k string, b double"),
        KEY, [{"left": "a", "right": "b", **value}])
    r = left.first()
    return r["a-Difference"], r["a-Match"]


def test_tolerances(spark):
    assert one(spark, 10.0, 10.0) == (0.0, "Matched")
    assert one(spark, 10.0, 12.0) == (2.0, "Unmatched")
    assert one(spark, 10.0, 12.0, threshold_type="amount", threshold_value=2) == (2.0, "Matched")  # equality is within
    assert one(spark, 9.0, 11.0, threshold_type="percent", threshold_value=20) == (2.0, "Matched")
    assert one(spark, 9.0, 11.1, threshold_type="percent", threshold_value=20)[1] == "Unmatched"
    assert one(spark, 10.0, 10.0, threshold_type="amount", threshold_value=0) == (0.0, "Matched")


def test_unmatched_rows_are_kept(spark):
    left, right = make(15, "a", 3), make(16, "b", 2)
    a, b = run(spark, left, right, "closest")
    assert a.count() == 3 and b.count() == 2
    assert {r["amt-Match"] for r in a.collect()} == {"Unmatched"} and {r["Reco_Status"] for r in b.collect()} == {None}


def test_key_noise_and_shown_keys(spark):
    left = table(spark, [("A-1 ", 1, "x", 1.0, 0.0), (None, 2, "x", 1.0, 0.0)])
    right = table(spark, [("a1", 1, "x", 1.0, 0.0), ("", 2, "x", 1.0, 0.0)])
    keys = [{"left": "k", "right": "k", "case_sensitive": "no", "ignore_special": "yes"}]
    a, _ = reconcile(left, right, keys, VALUE)
    assert [r["k"] for r in a.orderBy("id").collect()] == ["A-1 ", ""]
    assert [r["Reco_Status"] for r in a.collect()] == ["Matched"] * 2


def test_many_sides_are_summed(spark):
    left = table(spark, [("a", 1, "x", 1.0, 0.0), ("a", 2, "x", 2.0, 0.0), ("c", 3, "x", 2.0, 0.0)])
    right = table(spark, [("a", 1, "x", 3.0, 0.0), ("b", 2, "x", 2.0, 0.0), ("b", 3, "x", 2.5, 0.0)])
    a, b = reconcile(left, right, KEY, VALUE, {"method": "many-to-many"}, {"left": ["__Custom__"], "right": ["k"]}, ("L", "R"))
    assert sorted((r["k"], r["amt"], r["Custom-ID"], r["k-2"], r["amt-2"], r["amt-Match"]) for r in a.collect()) == [
        ("a", 3.0, "L-1", "a", 3.0, "Matched"), ("c", 2.0, "L-2", None, None, "Unmatched")] 
    assert {(r["k"], r["amt"]): r["Custom-ID"] for r in b.collect()} == {("a", 3.0): "L-1", ("b", 4.5): None}
    a, b = reconcile(left, right, KEY, VALUE, {"method": "one-to-many"})
    assert a.count() == 3 and b.count() == 2 and a.filter("Reco_Status is not null").count() == 1


@pytest.mark.parametrize(("keys", "values", "settings", "cross"), [
    ([{"left": "k", "right": "k", "criteria": "fuzzy"}], [], {}, {}),
    (KEY, [{"left": "amt", "right": "amt", "threshold_value": -1}], {}, {}),
    (KEY, [{"left": "amt", "right": "amt", "threshold_type": "percent", "threshold_value": 101}], {}, {}),
    (KEY, VALUE, {"method": "some-to-some"}, {}),
    (KEY, VALUE, {"duplicate": "nearest"}, {}),
    (KEY, VALUE, {"duplicate": "closest"}, {}),
    (KEY, VALUE, {"basis_table": "middle"}, {}),
    (KEY, VALUE, {"method": "one-to-many"}, {"right": ["id"]}),
    (KEY, VALUE, {"method": "many-to-one"}, {"left": ["id"]}),
    (KEY, VALUE, {}, {"left": ["amt"]}),
])
def test_bad_specs(keys, values, settings, cross):
    with pytest.raises(ValueError):
        check_spec(keys, values, settings, cross)


def test_spellings_and_sides():
    basis = {"left": "d", "right": "d"}
    assert check_spec(KEY, VALUE, {"duplicate": "immedidately_before", "basis_column": basis}).choice == nearest.BEFORE
    assert check_spec(KEY, VALUE, {"duplicate": "first_occurance"}).choice == "first_occurrence"
    assert check_spec(KEY, [{"left": "a", "right": "b", "threshold_value": 0}]).values
    # The documented "many" side is checked: right for one-to-many.
    assert check_spec(KEY, VALUE, {"method": "one-to-many"}, {"left": ["id"], "right": ["k"]}).refs["left"] == ["id"]


def test_block_sizes(spark, rows):
    sizes = block_sizes(table(spark, make(17, "a", 4)), table(spark, make(18, "b", 3)), KEY)
    assert rows(sizes) == [("a", 4, 0), ("b", 0, 3)]


def test_missing_column(spark):
    with pytest.raises(ValueError, match="right table"):
        reconcile(table(spark, make(19, "a", 2)), table(spark, make(20, "a", 2)), [{"left": "k", "right": "q"}], VALUE)


def test_time_basis(spark):
    at = F.to_timestamp_ntz
    left = spark.createDataFrame([("a", 1, "2024-01-01 10:00:00")], "k string, id long, s string").select("k", "id", at("s").alias("day"), F.lit(1.0).alias("amt"))
    right = spark.createDataFrame([("a", 1, "2024-01-01 11:30:00"), ("a", 2, "2024-01-01 09:00:00.5")], "k string, id long, s string").select("k", "id", at("s").alias("day"), F.lit(1.0).alias("amt"))
    spec = {"duplicate": "closest", "basis_column": {"left": "day", "right": "day"}}
    a, _ = reconcile(left, right, KEY, VALUE, spec, {"left": ["id"], "right": ["id"]})
    assert pairs_of(a) == {(1, 2)}


def test_exact_keys_keep_microseconds_and_booleans(spark):
    def side(*stamps):
        df = spark.createDataFrame([(i, s, i % 2 == 0 if i < 2 else None) for i, s in enumerate(stamps)], "id long, s string, flag boolean")
        return df.select("id", F.to_timestamp_ntz("s").alias("at"), "flag", F.lit(1.0).alias("amt"), F.col("id").cast("double").alias("day"))

    left = side("2024-01-01 00:00:00.000001", "2024-01-01 00:00:00.000002", "2024-01-01 00:00:00.000003")
    right = side("2024-01-01 00:00:00.000001", "2024-01-01 00:00:00.000009", "2024-01-01 00:00:00.000003")
    keys = [{"left": "at", "right": "at"}, {"left": "flag", "right": "flag"}]
    for spec in ({}, {"duplicate": "closest", "basis_column": {"left": "day", "right": "day"}}):
        a, _ = reconcile(left, right, keys, VALUE, spec, {"left": ["id"], "right": ["id"]})
        assert pairs_of(a) == {(0, 0), (2, 2)}


@pytest.mark.parametrize("duplicate", ["first", "closest", "before", "after", "fuzzy", "join"])
def test_one_sided_groups_reach_no_task(spark, monkeypatch, duplicate):
    dealt = []

    def watched(df, *keys):
        dealt.append(df)
        return spread(df, *keys)

    spread = nearest.spread
    monkeypatch.setattr(nearest, "spread", watched)
    monkeypatch.setattr(fuzzy, "spread", watched)
    left = table(spark, [("", i, f"text {i}", 1.0, float(i)) for i in range(500)] + [("a", 900, "jon smith", 1.0, 3.0)])
    right = table(spark, [("only", i, f"text {i}", 1.0, float(i)) for i in range(400)] + [("a", 901, "john smith", 1.0, 3.0)])
    if duplicate == "join":
        got = [(r["left.id"], r["right.id"]) for r in fuzzy_join(left, right, KEY, [{"left": "name", "right": "name"}], ["id"], ["id"]).collect()]
    else:
        words = {"before": "immediately_before", "after": "immediately_after"}
        keys = [{**KEY[0], "criteria": "exact"}] + ([{"left": "name", "right": "name", "criteria": "fuzzy"}] if duplicate in ("first", "fuzzy") else [])
        settings = {"method": "one-to-one", "duplicate": words.get(duplicate, "closest"), "basis_table": "left", "basis_column": {"left": "day", "right": "day"}}
        if duplicate == "first":
            settings = {"method": "one-to-one"}
        out, _ = reconcile(left, right, keys, VALUE, settings, {"left": ["id"], "right": ["id"]})
        got = sorted(pairs_of(out))
    assert got == [(900, 901)]
    assert dealt and [df.count() for df in dealt] == [2] * len(dealt)


def test_small_blocks_are_scored_together_however_batches_are_cut():
    """Many blocks give one set of pairs, not one each; blocks over batch ends, one-sided ones and empty texts too."""
    rng = random.Random(3)
    rows = [(f"{g:04}", side, "".join(rng.choice("abc") for _ in range(rng.randrange(8)))) for g in range(400) for side in (0, 1) for _ in range(rng.randrange(4))]
    table = pd.DataFrame(rows, columns=["g", "side", "v0"])
    score = lambda a, b: jaro_winkler_scores(np.array([a], dtype=object), np.array([b], dtype=object))
    wanted = sorted((g, a, b) for g, s, a in rows for h, t, b in rows if g == h and (s, t) == (0, 1) and len(score(a, b)) and score(a, b)[0] >= 0.85)
    for size in (1, 7, len(rows)):
        sets = list(_scored_blocks(iter([table[at : at + size] for at in range(0, len(rows), size)]), 1, 0.85))
        found = [x for s in sets for x in zip(s.left["g"][s.i], s.left["v0"][s.i], s.right["v0"][s.j])]
        assert sorted(found) == wanted
    assert len(sets) == 2 and wanted
