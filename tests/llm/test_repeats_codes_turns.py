"""Repeated passages, vector codes and repaired conversations against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import TESTDATA

from tallyframe.llm import codes, passages, queries, turns

here = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables not present")


def repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [7, 8, 60])
@pytest.mark.parametrize("shard", [40, 10**6])
def test_merged_transforms(length, shard):
    rng = random.Random(length)
    base = [bytes(rng.choices(b"ab\0c", k=3 * length)) for _ in range(5)]
    records = [rng.choice(base)[x : x + rng.randrange(length, 2 * length)] for x in rng.choices(range(length), k=25)]
    seen = collections.Counter(r[i : i + length] for r in records for i in range(len(r) - length + 1))
    want = [i + length <= len(r) and seen[r[i : i + length]] > 1 for r in records for i in range(len(r) + 1)]
    assert passages.repeated_windows(records, length, shard).tolist() == want


def test_common_prefixes():
    """One symbol a byte: the merged order and its common prefixes are those of all suffixes sorted."""
    records = [b"banana", b"ananas", b"bandana"]
    flat = np.frombuffer(b"\0".join(records) + b"\0", np.uint8)
    since = np.concatenate([np.arange(len(r) + 1) for r in records])
    left = np.concatenate([len(r) - np.arange(len(r) + 1) for r in records])
    symbol, edges = passages.name_symbols(flat, 1), [0, 7, 14, 22]
    shards = [passages.Shard(symbol[a:b], left[a:b], since[a:b], 1, 8) for a, b in zip(edges, edges[1:])]
    turn, common = passages.merge(shards, 8)
    at, seen = [], [0, 0, 0]
    for t in turn:
        at.append(edges[t] + shards[t].places[seen[t]])
        seen[t] += 1
    suffix = [bytes(flat[p : p + left[p]]) for p in at]
    assert suffix == sorted(suffix)
    shared = [0] + [len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b)))) for a, b in zip(suffix, suffix[1:])]
    assert common.tolist() == shared


@here
@pytest.mark.parametrize("settings", [{}, {"length": 60, "hot_bytes": 2000, "chunk": 5000, "shard_bytes": 1500}], ids=["plain", "hot"])
def test_passages(spark, settings):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    rows = passages.repeated_passages(docs, with_text=True, **settings).collect()
    given = docs.select("doc_id", "text").collect()
    want = repeats([(r["text"] or "").encode() for r in given], settings.get("length", 400))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows) == sorted((r["doc_id"], *w) for r, w in zip(given, want))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows) and any(r["spans"] for r in rows)


def test_passage_edges(spark):
    long = "é" + "".join(random.Random(3).choices("abcdef ", k=3000))
    rows = [(None, None, 1), (2, "", 2), (2**53 + 1, long, 3), (2**53 + 1, long, 3), (5, "x" * 900, 4), (6, "y" + long[:450], 5), (7, "short", 6), (8, "short", 7), (9, long[5:300], 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)
    got = passages.repeated_passages(docs).collect()
    want = repeats([(t or "").encode() for _, t, _ in rows], 400)
    key = lambda r: (r[0] is not None, *[x or 0 for x in r[:1]], *r[1:])
    assert sorted(((r[0], r[1], r[2], len(r[3]), r[4]) for r in got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert passages.repeated_passages(docs.filter("1 = 0")).collect() == []


def pq(rows, parts, entries, rounds, scale):
    x = [[int(np.floor(scale * float(c))) for c in v] for _, _, v in rows]
    wide = len(x[0]) // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    start = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    books = [[list(cut(x[i], p)) for i in start] for p in range(parts)]
    dist = lambda a, b: sum((m - n) ** 2 for m, n in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        to = [[near(v, p) for p in range(parts)] for v in x]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, t in zip(x, to) if t[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for (i, label, _), v in zip(rows, x):
        code = [near(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c in code), sum(dist(cut(v, p), books[p][c]) for p, c in enumerate(code))))
    total = collections.Counter()
    for _, label, _, e in out:
        total[label] += e
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return [(i, label, code, e, total[label], digest) for i, label, code, e in out]


def test_codes(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, 1, 2]), [rng.choice([rng.gauss(0, 1), 0.5, -0.001]) for _ in range(8)]) for _ in range(150)]
    bad = [(1, 1, None), (2, 1, [None] + [1.0] * 7), (3, 1, [float("nan")] * 8), (4, 1, [float("inf")] * 8), (500, 1, [1.0] * 9), (501, 1, [1.0] * 4)]
    df = spark.createDataFrame([(i, lab, v, 1) for i, lab, v in rows + bad], "vec_id long, label int, embedding array<double>, x int").repartition(4)
    got = codes.compress(df, parts=4, entries=20)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or 0, r[2], r[3])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(pq(rows, 4, 20, 2, 256), key=key)
    assert codes.compress(df.filter("1 = 0")).collect() == [] and codes.compress(df.limit(0), parts=4).columns == got.columns


def test_codes_large(spark):
    rows = [(i, 1, [1e12 * (i % 3), -3e9 * i, 0.25, float(i)]) for i in range(12)]
    got = codes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), parts=2, entries=3)
    want = [(*r[:3], min(r[3], 2**63 - 1), min(r[4], 2**63 - 1), r[5]) for r in pq(rows, 2, 3, 2, 256)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@here
def test_codes_sql(spark):
    got = queries.op12_codes(spark, str(TESTDATA))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{TESTDATA}/embeddings.parquet'")
    want = duckdb.sql(queries.SQL["op12_codes"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, edits, turns) by trying all edits of a few turns, best first by cost and letters."""
    marks, best = faults(rows), {(0, ""): (0, "", ())}
    layer = {"": (0, "", ())}  # by the initials so far, cut to what decides the rest

    def fits(s):
        return re.fullmatch(r"s?(ua)*u?", s) is not None

    def key(s):
        return s if s in ("", "s") else s[-1]

    def put(to, cost, letters, turns):
        s = "".join(r[:1] for r, _ in turns)
        if fits(s):
            to[key(s)] = min(to.get(key(s), (cost, letters, turns)), (cost, letters, turns))

    def inserted(layer):
        out = {}
        for cost, letters, turns in layer.values():
            for k in range(3):
                for names in itertools.product(("user", "assistant"), repeat=k):
                    put(out.setdefault(k, {}), cost + 5 * k, letters + "I" * k, turns + tuple((n, "") for n in names))
        return [e for k in out.values() for e in k.values()]

    for (_, role, text), mark in zip(rows, marks):
        to = {}
        for cost, letters, turns in inserted(layer):
            put(to, cost + 2, letters + "D", turns)
            if mark not in ("blank", "duplicate"):
                more = 5 if mark == "truncated" else 0
                put(to, cost + more, letters + "K", (*turns, (role, text)))
                for name in ("user", "assistant"):
                    put(to, cost + more + 1, letters + "R", (*turns, (name, text)))
        layer = to
    ends = [e for e in inserted(layer) if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in e[2]))]
    return min(ends)


def audit(rows):
    """rows: (turn, role, text) of one conversation, in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    marks = collections.Counter(faults(rows))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, letters, kept = cheapest(rows)
    return (gaps, marks["blank"], marks["duplicate"], marks["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def in_order(rows):
    h = lambda t: hashlib.md5(t.encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], h(r[2])))


@pytest.mark.parametrize("segment", [3, 1 << 16])
def test_repair(spark, segment):
    rng = random.Random(segment)
    convs = {}
    for c in [None, *range(2**53, 2**53 + 60)]:
        convs[c] = [(rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", "User", " "]), rng.choice(["Hi.", "Hi.", "Well", "What?\n", " \t", "", "é!", "x" * 50 + "."])) for _ in range(rng.randrange(1, 12))]
    rows = [(c, t, r or None, x if x != " \t" else None) for c, v in convs.items() for t, r, x in v]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    job = turns.Repair(df, segment=segment)
    got = {r["conv_id"]: r for r in job.plan().collect()}
    sha = {r["conv_id"]: r["repaired_sha256"] for r in job.digests().collect()}
    made = collections.defaultdict(list)
    for r in sorted(job.turns().collect(), key=lambda r: r["place"]):
        made[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for c, v in convs.items():
        want = audit(in_order([(t, r or " ", " " if x == " \t" else x) for t, r, x in v]))
        assert (*[got[c][n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], sha[c]) == want
        assert hashlib.sha256("\n".join(made[c]).encode()).hexdigest() == sha[c]


def test_repair_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair(df, turns.damage(df)).collect() == []
    one = spark.createDataFrame([(1, 1, "user", "Hi.", "z")], "conv_id long, turn long, role string, text string, hash string")
    assert [tuple(r) for r in turns.repair(one, one.filter("1 = 0")).collect()] == [(1, *audit([]))]


@here
def test_damaged(spark):
    got = {r[0]: tuple(r[1:]) for r in queries.op13_turns(spark, str(TESTDATA)).collect()}
    convs = collections.defaultdict(list)
    for r in spark.read.parquet(f"{TESTDATA}/conversations.parquet").collect():
        k = zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20
        role, text = [" " if x is None else x for x in (r["role"], r["text"])]
        row = (r["turn"], "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        convs[r["conv_id"]] += [] if k == 0 else [row] * (2 if k == 3 else 1)
    assert got == {c: audit(in_order(v)) for c, v in convs.items()}
