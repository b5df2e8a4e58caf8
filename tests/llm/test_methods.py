"""Each operator against brute force, a round trip, or held-out accuracy."""

import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from tallyframe.llm import automata, licenses, line_dedup, near_copies, outliers, packing, pieces, pii, secrets, top_k, toxicity, words

here = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables not present")


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{TESTDATA}/documents.parquet").set_index("doc_id").text


def groups(pairs, names):
    top = {n: n for n in names}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[find(a)] = find(b)
    out = {}
    for n in names:
        out.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, out.values()))


def test_word_hashes():
    h, doc = words.word_hashes(["a bb ccc a", "bb  a\tccc", "", "x" * 3000 + " ccc"])
    assert doc.tolist() == [0, 0, 0, 0, 1, 1, 1, 3, 3] and len(set(h.tolist())) == 4
    assert h[0] == h[3] == h[5] and h[1] == h[4] and h[2] == h[6] == h[8]
    many = [f"w{i}" for i in range(50000)]
    assert len(set(words.word_hashes([" ".join(many)])[0].tolist())) == 50000


def test_edit_within(spark):
    rng, pairs = random.Random(1), []
    for _ in range(400):
        a = [rng.choice("abcé") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k, i = rng.randint(0, 2), rng.randint(0, max(len(b) - 1, 0))
            b[i : i + (k > 0)] = [rng.choice("abc")] if k < 2 else []
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", line_dedup.edit_within(F.col("a"), F.col("b"), edits).alias("ok")).collect()
        assert [r for r in got if r.ok != (edit(r.a, r.b) <= edits)] == []


@pytest.mark.parametrize("group_texts", [64, 5])
def test_near_lines(spark, group_texts):
    rng = random.Random(2)
    lines = ["".join(rng.choice("ab") for _ in range(rng.randint(9, 12))) for _ in range(150)]
    lines += ["common beginning of a line " + "".join(rng.choice("abcdef") for _ in range(6)) for _ in range(100)]
    names = sorted(set(lines))
    want = groups([(a, b) for a, b in itertools.combinations(names, 2) if edit(a, b) <= 1], names)
    of = {hashlib.md5(n.encode()).digest(): n for n in names}
    root = line_dedup.near_lines(spark.createDataFrame([(x,) for x in lines], "line string"), 1, group_texts).collect()
    assert groups([(of[bytes(r.node)], of[bytes(r.root)]) for r in root], names) == want


def test_dedup_lines(spark):
    line = "a line of some length that several documents share"
    rows = [(3, f"{line}\nshort\nown line of document three, only here"), (1, f"first\n {line}x \nshort"), (2, line), (2, line)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"first\n {line}x \nshort", 2: "", 3: "short\nown line of document three, only here"}


def test_dedup_short_lines(spark, tmp_path):
    import corpus_pipeline
    from tallyframe.llm import queries

    rows = [(1, "Read more\n \nHome page top\nnineteen characters"), (2, "Read more \nRead mare\nHome page tap\nHome page tip!"), (3, "nineteen characterss\n\nown\nRead more"), (4, "nineteen charactersst\nown\nHome"), (5, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: rows[0][1], 2: "Read mare\nHome page tip!", 3: "\nown", 4: "Home", 5: ""}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: r.text_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert sum(r.n_removed for r in got.values()) == 7
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert left == {i: t for i, t in want.items() if t}


@here
def test_near_copies(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = words.WORD.findall(t)
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = near_copies.near_copies(docs).collect()
    assert groups([(r.doc_id, r.class_id) for r in got], list(sets)) == groups(links, list(sets))
    kept = near_copies.drop_near_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got})


def test_probability_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = ({int(x): float(w) for x, w in zip(rng.choice(40, 20, False), rng.integers(1, 6, 20))} for _ in range(2))
        want = sum(1 / sum(max(a.get(d, 0) / a[x], b.get(d, 0) / b[x]) for d in a.keys() | b.keys()) for x in a.keys() & b.keys())
        v = [(np.array(sorted(m), np.uint64), np.array([m[k] for k in sorted(m)])) for m in (a, b)]
        assert abs(near_copies.probability_jaccard(*v) - want) < 1e-9
        items = np.concatenate([v[0][0], v[1][0]])
        s = near_copies.prob_min_hash(np.repeat([0, 1], 20), words.mix(items), np.concatenate([v[0][1], v[1][1]]), 2, 4000)
        assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_large_group_of_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"v{i}_{k}" for k in range(60))) for i in range(50)]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("class_id").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 50 + [300]


def test_automaton():
    terms = ["idiot", "moron", "stupid", "scum", "lowei*"]
    lexicon, rng = automata.Lexicon(terms), random.Random(5)
    probes = {"".join(rng.choice("idotmrnsu") for _ in range(rng.randint(3, 7))) for _ in range(3000)} | {"idiot", "idit", "idiott", "xdiot", "scm", "loweiab", "lowe", "stupd"}
    text = " ".join(sorted(probes))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    got = {text[a:].split(" ")[0]: bool(near) for a, _, _, near in zip(*lexicon.hits(codes))}
    want = {}
    for p in probes:
        if p in terms or p.startswith("lowei"):
            want[p] = False
        elif any(edit(p, t) <= 1 for t in terms[:3]):
            want[p] = True
    assert got == want


def test_automaton_stems():
    terms, rng = ["scum", "idi", "lowei*", "scab*", "idiot"], random.Random(15)
    lexicon = toxicity.Scorer([(t, 0.9) for t in terms]).lexicon
    probes = {"".join(rng.choice("idotscumablwe") for _ in range(rng.randint(2, 8))) for _ in range(3000)}
    probes |= {"".join(c for i, c in enumerate(t + "ab") if i != k) for t in ("lowei", "scab", "scum", "idiot") for k in range(7)} | {"loweiab", "lowe", "lxwei", "lxweiab", "scm", "scumm", "sscabx"}
    text = " ".join(sorted(probes))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    got = {text[a:].split(" ")[0]: (bool(near), text[a:b]) for a, b, _, near in zip(*lexicon.hits(codes))}
    want = {}
    for p in probes:
        if p in ("scum", "idi", "idiot"):
            want[p] = (False, p)
        elif p.startswith(("lowei", "scab")):
            want[p] = (False, p[: 5 if p[0] == "l" else 4])
        elif any(edit(p, t) <= 1 for t in ("scum", "idiot")):
            want[p] = (True, p)
        elif near := [p[:k] for k in range(3, 7) if any(edit(p[:k], t) <= 1 for t in ("lowei", "scab"))]:
            want[p] = (True, near[0])
    assert got == want


def test_quotation():
    s = toxicity.Scorer([("idiot", 0.99), ("moron", 0.99)])
    e = s.evidence(['he said "you idiot" to them', "you idiot, you moron", "you idiott", "nothing here", "“an idiot” they wrote", 'one "quoted word" and an idiot "again"'])
    assert e["n_quoted"].tolist() == [1, 0, 0, 0, 1, 0] and e["n_misspelled"].tolist() == [0, 0, 1, 0, 0, 0]
    assert e["evidence"][1] > e["evidence"][2] > e["evidence"][0] > e["evidence"][3] == 0


def test_toxicity_held_out(spark):
    rng, rows, marks = random.Random(6), [], []
    plain = ["".join(rng.choice("abdegilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    for i in range(900):
        w = [rng.choice(plain) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for x in (["vileword", "rottenone", "blargstem" + rng.choice(["a", "ung", "heit", "er"])]):
                w.insert(rng.randrange(60), x)
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, y).join(y, "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.97


def test_terms_of_few_forms(spark):
    rows, forms = [], ["vileword"] * 12 + ["vilewords"] * 8 + ["vilest"] * 6 + ["grimtoad"] * 60 + ["grimly"] * 5 + ["ruinx", "ruinxa", "ruinxb"] * 40 + ["ruinous"] * 3
    rows = [(f"left{i} {w} right{i}", True) for i, w in enumerate(forms)] + [(f"left{i} plain right{i}", False) for i in range(200)]
    terms = dict(toxicity.learn_terms(spark.createDataFrame(rows, "t string, toxic boolean")))
    assert {t for t in terms if t[:4] not in ("left", "righ")} == {"vile*", "grimtoad", "grimly", "ruinx*"}
    rows = [r for r in rows if "vilest" not in r[0]]
    terms = dict(toxicity.learn_terms(spark.createDataFrame(rows, "t string, toxic boolean")))
    assert terms["vileword"] == 12 / 15 and terms["vilewords"] == 8 / 11


def test_personal_data():
    text = "mail a.b@x.org, ip 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111, 4111111111111112, phone +1 (555) 123-4567 é x@y.de"
    got = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert got == [("email", "a.b@x.org"), ("email", "x@y.de"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert pii.mask("a b@c.d e", [("email", 2, 7)]) == "a [EMAIL] e"


def test_chain_decodes_exactly():
    rng, field = np.random.default_rng(7), pii.Field()
    field.emit = rng.normal(size=field.emit.shape)
    field.move = rng.normal(size=field.move.shape)
    p = pii.pieces(0, "call +1 555-123 4@5")[0]
    path, s, move = field.decode([p])[0], field.scores([p])[0], field.move + field.ban
    best = max(itertools.product(range(len(pii._LABELS)), repeat=len(path)), key=lambda y: move[0, y[0]] + move[y[-1], 0] + sum(s[i, k] for i, k in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
    assert list(best) == path


def test_chain_learns_shapes():
    field, rng = pii.Field(), random.Random(8)
    line = lambda: f"word {rng.choice(['reach', 'mail'])} {''.join(rng.choice('abcdef') for _ in range(5))}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com and {rng.randint(100, 99999)} more"
    data = [(p, pii.gold(p, pii.base_spans(x))) for x in (line() for _ in range(200)) for p in pii.pieces(0, x)]
    field.train(data)
    test = [(p, pii.gold(p, pii.base_spans(x))) for x in (line() for _ in range(100)) for p in pii.pieces(0, x)]
    right = sum(a == b for (_, y), got in zip(test, field.decode([p for p, _ in test])) for a, b in zip(y, got))
    assert right / sum(len(y) for _, y in test) > 0.99


def test_boundaries():
    rng = np.random.default_rng(9)
    n, c = np.array([1, 4, 5, 9, 12, 20, 21]), rng.integers(1, 9, 7)
    pad = lambda b: sum(k * (min(x for x in b if x >= v) - v) for v, k in zip(n, c))
    for k in (1, 2, 3):
        best = min(pad(set(b) | {21}) for b in itertools.combinations(n, k - 1))
        assert pad(packing.boundaries(n, c, k)) == best and len(packing.boundaries(n, c, k)) <= k


@here
def test_pack(docs, texts):
    got = packing.pack(docs, context=500, budget=4000, buckets=4, shard_rows=10).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: len(words.WORD.findall(t)) for i, t in texts.items()}
    b = got.dropna().groupby(["bucket", "batch"]).agg(n=("doc_id", "size"), padded=("padded", "first"))
    assert (b.n * b.padded <= 4000).all()
    short = b.reset_index().groupby("bucket").apply(lambda g: (g.n < 4000 // g.padded).sum())
    assert (short <= 1).all()


@here
def test_secrets(docs, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in secrets.find_secrets(docs).collect():
        t = texts[r.doc_id]
        s = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(s)).encode()).hexdigest()


def test_ownership(spark):
    copied, own = "Zx9" + "aB3" * 8, "Qr7" + "cD5" * 8
    rows = [(i, f"é key {copied} token=abc password: hunter22", f"o{i}", "main") for i in range(5)] + [(9, f"mine {own}", "o1", "main")]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got[9].spans == f"owned:5:{5 + len(own)}" and got[9].n_live == 1
    assert "owned" not in got[0].spans and got[0].n_example == 1 and got[0].n_assign == 1


def test_licenses():
    names = licenses.Templates(licenses.TEMPLATES)
    assert names.index
    filler = " ".join(f"word{i}" for i in range(200))
    docs = {k: f"{filler} {v}! {filler}" for k, v in licenses.TEMPLATES.items()}
    for name, t in docs.items():
        h = words.placed_hashes([t.encode().translate(licenses._FOLD)])[0]
        items = licenses._shingles(h)
        assert name in {names.names[i] for i, _, _ in names.matches(items, names.known(items))}, name


def test_pieces():
    m = pieces.Pieces([(i, p, -float(s)) for i, (p, s) in enumerate({"▁a": 3, "b": 2, "ab": 4, "▁": 1, "a": 2, "bc": 6, "c": 3, "▁ab": 6, "abc": 5}.items(), 256)], list(range(256)))

    def ways(u):
        out = []

        def go(i, s, ids):
            if i == len(u):
                out.append((s, ids))
            for j in range(i + 1, min(len(u), i + m.longest) + 1):
                if u[i:j] in m.ids:
                    go(j, s + m.score[u[i:j]], ids + [m.ids[u[i:j]]])
                elif j == i + 1:
                    go(j, s + m.missing, ids + m.spell(u[i:j]))

        go(0, 0.0, [])
        return sorted(out, key=lambda x: -x[0])

    for u in ("▁abc", "abcabc", "é", "▁xab", "▁▁a"):
        b, a = ways(u), m.n_best(u, 4)
        assert np.allclose([b[0][0] - x for x, _ in b[:4]], [abs(x) for x, _ in a]) and len({tuple(i) for _, i in a}) == len(a)
        best, loss, ids = m.segment([u])
        assert np.isclose(best[0], b[0][0]) and (np.isclose(loss[0], b[0][0] - b[1][0]) if len(b) > 1 else np.isinf(loss[0])) and m.decode(ids[0]) == u.replace("▁", " ").removeprefix(" ")
    text = "abc ab\n\nxé  a b"
    units = pieces._UNIT.findall(("▁" + text).replace(" ", "▁"))
    want = sorted(sum(w[0][0] - x[0] for w, x in zip(map(ways, units), c)) for c in itertools.product(*[ways(u)[:4] for u in units]))[:4]
    got = pieces.encode([text], m, 4, {})[0]
    assert np.allclose(got["losses"], want) and m.decode(list(map(int, got["ids"].split(",")))) == text and got["decoded"]


@here
def test_top_k(spark):
    v = spark.read.parquet(f"{TESTDATA}/embeddings.parquet")
    pdf = v.toPandas()
    m, ids = np.floor(1024 * np.array(pdf.embedding.tolist(), float)).astype(np.int64), pdf.vec_id.to_numpy()
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        s = m @ m[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:10]
        want += [(int(ids[q]), r, int(ids[i]), int(s[i])) for r, i in enumerate(order, 1)]
    for options in ({}, {"block": 2, "tile": 16, "fan_in": 2}):
        assert sorted(tuple(r) for r in top_k.top_k(v, **options).collect()) == sorted(want)


@here
def test_base_counts(texts):
    some = list(texts[:60])
    base, _ = outliers.counts(some)
    for t, r in zip(some, base.itertuples()):
        w = words.WORD.findall(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words.WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))


def test_outliers(spark):
    rng, rows = random.Random(10), []
    for i in range(400):
        rows.append((i, " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(100)), "en", "s" if i < 300 else "t"))
    rows.append((999, " ".join("ABCDEFGHIJKLMNOP" + str(i) + "###" for i in range(100)), "en", "s"))
    got = outliers.reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} >= {999} and sum(not r.kept for r in got) <= 12


@here
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(TESTDATA))
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            out = out.cache()
            counts.append(out.count())
            docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.filter(F.col("text").rlike(r"[a-z0-9]@mail\d")).count() == 0
    assert docs.filter(F.length("text") != F.col("n_chars")).join(spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id"), "doc_id").count() == 0
    assert out.select("doc_id").distinct().count() == counts[-1]
