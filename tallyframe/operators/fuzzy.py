"""Blocked and fuzzy candidate joins, and the greedy pairing of small blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.batches import whole_groups
from tallyframe.functions.names import all_of, col, cols, join_keys, require, shared_groups
from tallyframe.functions.similarity import (
    MATCH_SCORE,
    TextSet,
    jaro_winkler,
    plain_bound,
    score_pairs,
    signature_column,
)
from tallyframe.functions.text import group_id
from tallyframe.operators.joins import _keyed, _pairs
from tallyframe.session import BLOCK_PAIRS, cut, setting, spread

_BATCH_PAIRS = 100_000  # pairs scored together, over many small blocks
_BATCH_CHARS = 20_000_000  # text held for them
_CHARS_PER_PAIR = 50  # text a block may hold, per pair of the block limit


def blocked_pairs(left: DataFrame, right: DataFrame, key_pairs: list[dict], l_cols: list[str], r_cols: list[str]) -> DataFrame:
    """Candidate pairs that share every exact key, as ``left.<c>`` and ``right.<c>`` columns."""
    pairs = _pairs(left, right, key_pairs)
    require(left, l_cols, "first table")
    require(right, r_cols, "second table")
    l, r = _keyed(left, right, pairs, "typed")
    on = all_of(F.col(f"__lk{i}") == F.col(f"__rk{i}") for i in range(len(pairs)))
    return l.join(r, on).select(
        *[F.col(f"__l{left.columns.index(c)}").alias(f"left.{c}") for c in l_cols],
        *[F.col(f"__r{right.columns.index(c)}").alias(f"right.{c}") for c in r_cols],
    )


def large_blocks(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """Blocks ``g`` with more row pairs, rows or text than one task should hold, or None."""
    limit = setting(left.sparkSession, BLOCK_PAIRS)
    def sized(df: DataFrame, name: str) -> DataFrame:
        length = sum((F.length(c) for c in df.columns if c[0] in "ab" and c[1:].isdigit()), F.lit(0))
        return df.groupBy("g").agg(F.count(F.lit(1)).alias(f"n{name}"), F.sum(length).alias(f"c{name}"))

    sizes = sized(left, "l").join(sized(right, "r"), "g")
    pairs = F.col("nl").cast("double") * F.col("nr")
    rows, chars = F.col("nl") + F.col("nr"), F.col("cl") + F.col("cr")
    found = sizes.filter((pairs > limit) | (rows > limit) | (chars > limit * _CHARS_PER_PAIR)).select("g")
    return cut(found) if found.take(1) else None


def split_blocks(df: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary blocks, rows of large blocks)."""
    return join_keys(df, large, ["g"], "left_anti"), join_keys(df, large, ["g"], "left_semi")


def scored_texts(left: DataFrame, right: DataFrame, texts: int, threshold: float = MATCH_SCORE) -> DataFrame:
    """(g, a0.., b0.., s0): pairs of distinct text tuples of one block that reach ``threshold`` on every text.

    An ordinary block is scored inside one task, which emits the pairs at the threshold only. A large
    block goes through a signature join, which misses no pair at the threshold and leaves out those
    whose lengths and characters rule it out.
    """
    a, b = [f"a{i}" for i in range(texts)], [f"b{i}" for i in range(texts)]
    l, r = left.select("g", *a).distinct(), right.select("g", *b).distinct()
    large = large_blocks(l, r)
    if large is None:
        return _score_blocks(l, r, texts, threshold)
    (l, l_large), (r, r_large) = split_blocks(l, large), split_blocks(r, large)
    return _score_blocks(l, r, texts, threshold).unionByName(score_by_signature(l_large, r_large, texts, threshold))


def score_by_signature(l: DataFrame, r: DataFrame, texts: int, threshold: float) -> DataFrame:
    a, b = [f"a{i}" for i in range(texts)], [f"b{i}" for i in range(texts)]
    l = l.withColumn("sig", F.explode(signature_column(F.col("a0"), threshold, True)))
    r = r.withColumn("sig", F.explode(signature_column(F.col("b0"), threshold, False)))
    la, lb = F.length("a0"), F.length("b0")
    near = F.least(la, lb) >= (3 * plain_bound(threshold, 4) - 2) * F.greatest(la, lb) - 1e-9
    candidates = l.join(r, ["g", "sig"]).filter(near).select("g", *a, *b).distinct()
    # One score at a time: later texts are scored only for the pairs that are still in.
    for i in range(texts):
        candidates = candidates.withColumn(f"s{i}", jaro_winkler(F.col(f"a{i}"), F.col(f"b{i}")))
        candidates = candidates.filter(F.col(f"s{i}") >= threshold)
    return candidates.select("g", *a, *b, "s0")


def _sides(l: DataFrame, r: DataFrame, texts: int, extra: list[str]) -> DataFrame:
    """Both sides of each block that both have in one task, sorted by block, side and ``t``."""
    l, r = shared_groups(l, r)
    l = l.select("g", F.lit(0).alias("side"), *extra, *[F.col(f"a{i}").alias(f"v{i}") for i in range(texts)])
    r = r.select("g", F.lit(1).alias("side"), *extra, *[F.col(f"b{i}").alias(f"v{i}") for i in range(texts)])
    return spread(l.unionByName(r), "g").sortWithinPartitions("g", "side", *[e for e in extra if e == "t"])


class _Blocks:
    """Whole blocks side by side: rows of both sides, and the scored pairs (i, j) of rows that share a block."""

    def __init__(self, arrays: dict[str, np.ndarray], starts: np.ndarray, texts: int, threshold: float):
        right = arrays["side"] == 1
        self.left = {c: v[~right] for c, v in arrays.items()}
        self.right = {c: v[right] for c, v in arrays.items()}
        m = np.add.reduceat(right.astype(np.int64), starts)
        rows = np.diff(np.append(starts, len(right)))
        # Every left row meets the m right rows of its block, which begin at one place.
        own, first = np.repeat(m, rows - m), np.repeat(np.cumsum(m) - m, rows - m)
        i = np.repeat(np.arange(len(own)), own)
        j = np.arange(len(i)) + np.repeat(first - (np.cumsum(own) - own), own)
        scores = np.zeros(0)
        for k in range(texts):
            found, keep = score_pairs(TextSet(self.left[f"v{k}"]), TextSet(self.right[f"v{k}"]), i, j, threshold)
            i, j = i[keep], j[keep]
            scores = found if k == 0 else scores[keep]
        self.i, self.j, self.score = i, j, scores


def _scored_blocks(batches: Iterator[pd.DataFrame], texts: int, threshold: float) -> Iterator[_Blocks]:
    """Blocks of a sorted stream with their scored pairs, first text first; small blocks are scored together."""
    for arrays in whole_groups(batches, "g"):
        starts = np.flatnonzero(np.append(True, arrays["g"][1:] != arrays["g"][:-1]))
        right = np.add.reduceat((arrays["side"] == 1).astype(np.int64), starts)
        size = np.cumsum((np.diff(np.append(starts, len(arrays["g"]))) - right) * right)
        chars = np.cumsum(np.add.reduceat(sum(np.fromiter(map(len, arrays[f"v{k}"]), np.int64, len(arrays["g"])) for k in range(texts)), starts))
        at = 0
        while at < len(starts):
            done = (size[at - 1], chars[at - 1]) if at else (0, 0)
            stop = min(np.searchsorted(size, done[0] + _BATCH_PAIRS, "right"), np.searchsorted(chars, done[1] + _BATCH_CHARS, "right"))
            stop = max(at + 1, int(stop))
            part = slice(starts[at], starts[stop] if stop < len(starts) else None)
            yield _Blocks({c: v[part] for c, v in arrays.items()}, starts[at:stop] - starts[at], texts, threshold)
            at = stop


def _score_blocks(l: DataFrame, r: DataFrame, texts: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _scored_blocks(batches, texts, threshold):
            found = {"g": b.left["g"][b.i]}
            for k in range(texts):
                found |= {f"a{k}": b.left[f"v{k}"][b.i], f"b{k}": b.right[f"v{k}"][b.j]}
            yield pd.DataFrame(found | {"s0": b.score})

    names = ", ".join(f"a{k} string, b{k} string" for k in range(texts))
    scored = _sides(l, r, texts, []).mapInPandas(run, f"g string, {names}, s0 double")
    return scored.select("g", *[f"a{k}" for k in range(texts)], *[f"b{k}" for k in range(texts)], "s0")


def pair_blocks(base: DataFrame, others: DataFrame, texts: int, threshold: float, low: bool, high: bool) -> DataFrame:
    """Greedy one-to-one pairing of ordinary blocks: (g, t, ot).

    ``base`` holds g, t, x, a0..; ``others`` g, t, x, b0... Base rows choose in t order by score, text,
    distance, smaller x and t. ``low``/``high``: partners may lie at or below / at or above the base x.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _scored_blocks(batches, texts, threshold):
            bx, ox = b.left["x"][b.i], b.right["x"][b.j]
            fits = ~np.isnan(bx) & ~np.isnan(ox)
            if not low:
                fits &= ox >= bx
            if not high:
                fits &= ox <= bx
            i, j, score = b.i[fits], b.j[fits], b.score[fits]
            ranks = [np.unique(b.right[f"v{k}"], return_inverse=True)[1][j] for k in range(texts)]
            gap = np.abs(bx[fits] - ox[fits])
            # Left rows are numbered through the blocks, so the blocks stay in order and apart.
            order = np.lexsort((b.right["t"][j], ox[fits], gap, *reversed(ranks), -score, i))
            free_i, free_j = [True] * len(b.left["g"]), [True] * len(b.right["g"])
            found_i, found_j = [], []
            for p, q in zip(i[order].tolist(), j[order].tolist()):
                if free_i[p] and free_j[q]:
                    free_i[p] = free_j[q] = False
                    found_i.append(p)
                    found_j.append(q)
            if found_i:
                yield pd.DataFrame({"g": b.left["g"][found_i], "t": b.left["t"][found_i], "ot": b.right["t"][found_j]})

    return _sides(base, others, texts, ["t", "x"]).mapInPandas(run, "g string, t long, ot long")


def fuzzy_join(
    left: DataFrame,
    right: DataFrame,
    exact: list[dict],
    fuzzy: list[dict],
    l_cols: list[str],
    r_cols: list[str],
    threshold: float = MATCH_SCORE,
) -> DataFrame:
    """All row pairs equal on the exact keys and similar on every fuzzy key.

    Output: ``left.<c>``, ``right.<c>`` and ``score`` (of the first fuzzy key). Texts are scored once
    per distinct pair, then joined back to their rows.
    """
    if not exact or not fuzzy:
        raise ValueError("a fuzzy join needs at least one exact and one fuzzy key")
    require(left, l_cols, "first table")
    require(right, r_cols, "second table")
    e, f = _pairs(left, right, exact), _pairs(left, right, fuzzy)
    l, r = _keyed(left, right, e, "typed")

    def slim(df: DataFrame, table: DataFrame, side: int, letter: str, kept: list[str], name: str) -> DataFrame:
        keys = [F.col(f"__{'lr'[side]}k{i}") for i in range(len(e))]
        place = {c: F.col(f"__{'lr'[side]}{i}") for i, c in enumerate(table.columns)}
        texts: list[Column] = [place[p[side]].cast("string").alias(f"{letter}{i}") for i, p in enumerate(f)]
        known = all_of([k.isNotNull() for k in keys] + [place[p[side]].isNotNull() for p in f])
        return df.filter(known).select(group_id(*keys).alias("g"), *texts, *[place[c].alias(f"{name}.{c}") for c in kept])

    l, r = slim(l, left, 0, "a", l_cols, "left"), slim(r, right, 1, "b", r_cols, "right")
    n = range(len(f))
    scored = scored_texts(l, r, len(f), threshold)
    joined = scored.join(l, ["g", *[f"a{i}" for i in n]]).join(r, ["g", *[f"b{i}" for i in n]])
    return joined.select(*cols(f"left.{c}" for c in l_cols), *cols(f"right.{c}" for c in r_cols), col("s0").alias("score"))
