"""What a task holds and how many rows a step makes."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import line_dedup, passages


def _records(keys, each, size):
    """Batch for ``solve`` of ``each`` records of ``size`` bytes per key; in a key, all share their first half."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(keys):
        half = rng.integers(97, 123, size // 2, dtype=np.uint8).tobytes()
        rows += [(k, k * each + i, size - 39, 0, half + rng.integers(97, 123, size - size // 2, dtype=np.uint8).tobytes()) for i in range(each)]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["h", "rid", "n", "at", "rec"])


def test_steps_of_passages_are_bounded(monkeypatch):
    batch, sizes = _records(6, 9, 100), []
    whole = passages.repeated_windows
    monkeypatch.setattr(passages, "repeated_windows", lambda records, *a: sizes.append(sum(map(len, records))) or whole(records, *a))
    rows = lambda chunk: sorted(r for b in passages.solve(40, chunk, 1 << 19)(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns]))
    one = rows(1 << 20)
    assert sizes == [5400] and len(one) == 54
    sizes.clear()
    assert rows(1000) == one  # a key has 900 bytes: two of them do not fit
    assert sizes == [900] * 6
    sizes.clear()
    assert rows(500) == one  # a key beyond the limit is a step of its own
    assert sizes == [900] * 6


def test_memory_of_a_step_of_passages():
    records = _records(1, 400, 1000).column(4).to_pylist()
    passages.repeated_windows(records, 400)
    tracemalloc.start()
    try:
        passages.repeated_windows(records, 400)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70 * 400 * 1000


def _close(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1] <= 2


@pytest.mark.parametrize("group_texts", [64])
def test_lines_that_share_a_part_make_few_pairs(spark, monkeypatch, group_texts):
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(n))
    common = part(40)
    lines = [common + part(40) for _ in range(50)]
    near = lines[0][:70] + "##" + lines[0][72:]
    lines += [near, near[1:30] + "é" + near[30:]]
    made = []
    ordered = line_dedup._ordered
    monkeypatch.setattr(line_dedup, "_ordered", lambda pairs: made.append(ordered(pairs)) or made[-1])
    root = {r.node: r.root for r in line_dedup.near_lines(spark.createDataFrame([(x,) for x in lines], "line string"), 2, group_texts).collect()}
    node = {x: bytes.fromhex(r) for x, r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.md5("line")).collect()}
    want = {frozenset((a, b)) for a in lines for b in lines if a < b and _close(a, b)}
    assert want == {frozenset((lines[0], near)), frozenset((near, lines[-1]))}
    assert {x for x in lines if node[x] in root} == {lines[0], near, lines[-1]}
    assert len(set(root.values())) == 1
    # Of 1,326 pairs that share the part, those that the characters rule out are no rows.
    assert sum(p.count() for p in made) < 50


def test_signatures_of_near_lines_are_alike(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(200):
        a = b = "".join(rng.choice("ab cé€😀Z9") for _ in range(rng.randint(0, 12)))
        for _ in range(2):
            i = rng.randint(0, len(b))
            b = b[:i] + rng.choice(["", "x", "😀", "é"]) + b[i + rng.randint(0, 1) :]
        pairs.append((a, b))
    alike = line_dedup._alike(line_dedup.signature(F.col("a")), line_dedup.signature(F.col("b")), 2)
    assert spark.createDataFrame(pairs, "a string, b string").filter(~alike).isEmpty()


@pytest.mark.parametrize("group_texts", [64, 1])
def test_pairs_of_a_group_are_its_links(spark, monkeypatch, group_texts):
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(n))
    common, letters = part(40), "abcdefghijklmnopqrstuvwxyzé€0123456789"
    lines = [common + "".join(rng.sample(letters, len(letters))) for _ in range(60)]
    near = lines[0][:70] + "##" + lines[0][72:]
    lines += [near, near[1:30] + "é" + near[30:]]
    made, cross = [], line_dedup._cross
    monkeypatch.setattr(line_dedup, "_cross", lambda *a: made.append(line_dedup.keep(cross(*a))) or made[-1])
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    root = {r.node: r.root for r in line_dedup.near_lines(df, 2, group_texts).collect()}
    node = {x: bytes.fromhex(r) for x, r in df.select("line", F.md5("line")).collect()}
    assert {x for x in lines if node[x] in root} == {lines[0], near, lines[-1]}
    assert len(set(root.values())) == 1
    # All 1,770 pairs of permutations have the same characters; only the two links may be rows, once for each segment.
    assert made and sum(p.count() for p in made) <= 20


def test_pair_signatures_of_near_lines_are_alike(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(300):
        a = b = "".join(rng.choice("ab cé€😀Z9") for _ in range(rng.randint(0, 12)))
        for _ in range(2):
            i = rng.randint(0, len(b))
            b = b[:i] + rng.choice(["", "x", "😀", "é"]) + b[i + rng.randint(0, 1) :]
        pairs.append((a, b))
    alike = line_dedup._alike(line_dedup.pair_signature(F.col("a")), line_dedup.pair_signature(F.col("b")), 2, 4)
    assert spark.createDataFrame(pairs, "a string, b string").filter(~alike).isEmpty()


def _edited(rng, line, edits):
    for _ in range(edits):
        at, kind = rng.randint(0, len(line)), rng.randint(0, 2)
        line = line[:at] + ("" if kind == 0 else rng.choice("abcé")) + line[at + (kind != 1):]
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_a_segment_at_any_length(spark, edits):
    rng = random.Random(11)
    pairs = []
    for n in [*range(edits + 1, 37), 62, 63, 64, 65, 66, 79, 80, 81, 82, 130]:
        for _ in range(40):
            line = "".join(rng.choice("abcé") for _ in range(n))
            pairs.append((line, _edited(rng, line, edits)))
    lines = sorted({x for p in pairs for x in p if len(x) > edits})
    rows = line_dedup._rows(spark.createDataFrame(list(enumerate(lines)), "h long, rest string"), [], edits).select("h", "key", "kind").collect()
    keys = [{0: set(), 1: set()} for _ in lines]
    for r in rows:
        keys[r.h][r.kind].add(r.key)
    of = dict(zip(lines, keys))
    for a, b in pairs:
        if min(len(a), len(b)) > edits:
            x, y = of[a], of[b]
            assert x[0] & (y[0] | y[1]) or y[0] & x[1], (a, b)


def test_a_line_is_few_segment_rows(spark, monkeypatch):
    rng = random.Random(12)
    lines = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randint(64, 200))) for _ in range(300)]
    made, shared = [], line_dedup._shared
    monkeypatch.setattr(line_dedup, "_shared", lambda rows: made.append(rows.count()) or shared(rows))
    line_dedup.near_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert made[0] <= 5 * len(lines)


def test_lines_are_trimmed(spark):
    lines = ["", " ", "\t\r", "a", " a", "a\x0b", "\x0c a\x0b b \t", "\xa0a", "é \x0bé", " \x0b\x0c\r\t"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = {r.pos: r.line for r in line_dedup.lines_of(docs, "doc_id", "text", 0).collect()}
    assert got == {i: x.strip(" \t\n\x0b\x0c\r") for i, x in enumerate(lines)}
