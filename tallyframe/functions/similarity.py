"""Jaro-Winkler similarity on Arrow batches, and the signatures that make its join exact."""

from __future__ import annotations

from math import ceil, floor, log

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the measure: weight per shared leading character, how many of them count, and the
# plain similarity above which they count.
PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4
BOOST_ABOVE = 0.7
# Fixed value: default score from which two texts match.
MATCH_SCORE = 0.85
# Fixed value: letters from common to rare, used only to order the characters of a signature.
COMMON_LETTERS = "etaoinshrdlcumwfgypbvkjxqz"

_CELLS = 1_000_000  # matrix cells a scoring step may use
_BINS = 64  # character bins of the quick bound


class TextSet:
    """Texts as code point arrays, with their lengths and binned character counts."""

    def __init__(self, texts: np.ndarray):
        texts = [t or "" for t in texts]
        # One array of all code points; a text is a slice of it.
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        flat = np.bincount(owner * _BINS + (self.codes % _BINS).astype(np.int64), minlength=len(texts) * _BINS)
        self.bins = flat.reshape(-1, _BINS).astype(np.uint32)
        self.head = self.grid(np.arange(len(texts)), PREFIX_LENGTH, 0)

    def grid(self, pick: np.ndarray, width: int, pad: int) -> np.ndarray:
        """Codes of the picked texts, one row each, padded to ``width``."""
        made = np.full((len(pick), width), pad, dtype=np.uint32)
        inside = np.arange(width) < self.lengths[pick][:, None]
        made[inside] = self.codes[(self.starts[pick][:, None] + np.arange(width))[inside]]
        return made


def score_pairs(a: TextSet, b: TextSet, i: np.ndarray, j: np.ndarray, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(scores, positions) of the pairs (i, j) that reach ``threshold``.

    A bound from character counts settles most other pairs: the matched characters are at most the
    common ones, and transpositions only lower the score. An empty text scores 0.
    """
    keep = np.arange(len(i))
    if threshold > 0:
        kept = []
        for at in range(0, len(i), _CELLS // _BINS):
            p, q = i[at : at + _CELLS // _BINS], j[at : at + _CELLS // _BINS]
            common = np.minimum(a.bins[p], b.bins[q]).sum(axis=1, dtype=np.int64)
            la, lb = np.maximum(a.lengths[p], 1), np.maximum(b.lengths[q], 1)
            best = (common / la + common / lb + 1) / 3
            shared = np.cumprod((a.head[p] == b.head[q]) & (a.head[p] != 0), axis=1).sum(axis=1)
            best = np.where(best > BOOST_ABOVE, best + shared * PREFIX_WEIGHT * (1 - best), best)
            kept.append(at + np.flatnonzero((best >= threshold - 1e-9) & (common > 0)))
        keep = np.concatenate(kept) if kept else keep
    i, j = i[keep], j[keep]
    scores = np.zeros(len(i))
    widths = np.maximum(a.lengths[i], b.lengths[j])
    order = np.argsort(widths, kind="stable")
    start = 0
    while start < len(order):
        # Pairs of similar width share a matrix of at most _CELLS cells (a single pair may exceed it).
        stop = start + max(1, _CELLS // max(1, int(widths[order[start]])))
        while stop - start > 1 and (min(stop, len(order)) - start) * int(widths[order[min(stop, len(order)) - 1]]) > _CELLS:
            stop = start + (stop - start) // 2
        pick = order[start:stop]
        width = int(widths[pick[-1]])
        if width:
            scores[pick] = _batch(a, b, i[pick], j[pick], width)
        start = stop
    reached = scores >= threshold
    return scores[reached], keep[reached]


def jaro_winkler_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Score of each pair of texts."""
    at = np.arange(len(left))
    return score_pairs(TextSet(left), TextSet(right), at, at)[0]


def _batch(a_set: TextSet, b_set: TextSet, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    a_ids, a_at = np.unique(i, return_inverse=True)
    b_ids, b_at = np.unique(j, return_inverse=True)
    a, b = a_set.grid(a_ids, width, 0), b_set.grid(b_ids, width, 0)
    alphabet = np.unique(np.concatenate([np.unique(a), np.unique(b), [0]]))
    small = np.uint8 if len(alphabet) < 255 else np.uint32
    a, b = np.searchsorted(alphabet, a).astype(small)[a_at], np.searchsorted(alphabet, b).astype(small)[b_at]
    la, lb = a_set.lengths[i], b_set.lengths[j]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    places, rows = np.arange(width), np.arange(len(i))
    # Unmatched characters of b; a matched or padding place holds a code that equals nothing in a.
    used = small(np.iinfo(small).max)
    left = np.where(places < lb[:, None], b, used)
    a_hit = np.zeros(a.shape, dtype=bool)
    b_hit = np.zeros(b.shape, dtype=bool)
    widest, same_reach = int(reach.max()), bool((reach == reach[0]).all())
    for k in range(int(la.max())):
        low, high = max(0, k - widest), min(width, k + widest + 1)
        if low >= high:
            continue
        fits = left[:, low:high] == a[:, k : k + 1]
        if not same_reach:
            fits &= np.abs(places[low:high] - k) <= reach[:, None]
        first = fits.argmax(axis=1)
        found = fits[rows, first] & (k < la)
        at = rows[found], first[found] + low
        a_hit[found, k] = True
        b_hit[at] = True
        left[at] = used
    matches = a_hit.sum(axis=1)
    # The k-th matched character of one side is compared with the k-th of the other.
    a_row, a_col = np.nonzero(a_hit)
    b_row, b_col = np.nonzero(b_hit)
    unequal = a[a_row, a_col] != b[b_row, b_col]
    swapped = np.bincount(a_row, weights=unequal, minlength=len(i)).astype(np.int64) // 2
    safe = np.maximum(matches, 1)
    score = (matches / np.maximum(la, 1) + matches / np.maximum(lb, 1) + (matches - swapped) / safe) / 3
    score = np.where(matches > 0, score, 0.0)
    head = min(PREFIX_LENGTH, width)
    inside = places[:head] < np.minimum(la, lb)[:, None]
    shared = np.cumprod((a[:, :head] == b[:, :head]) & inside, axis=1).sum(axis=1)
    score = np.where(score > BOOST_ABOVE, score + shared * PREFIX_WEIGHT * (1 - score), score)
    return np.round(score, 12)  # equal similarities must tie, whatever the order of the sums


def jaro_winkler(a: Column, b: Column) -> Column:
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_scores(x.fillna("").to_numpy(), y.fillna("").to_numpy()))

    score.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, T.DoubleType())(a, b)


def plain_bound(threshold: float, shared: int) -> float:
    """Least Jaro similarity of a pair that reaches ``threshold`` with ``shared`` leading characters in common."""
    boosted = (threshold - PREFIX_WEIGHT * shared) / (1 - PREFIX_WEIGHT * shared)
    return min(threshold, max(boosted, BOOST_ABOVE))


# A pair that reaches the threshold has at least overlap(la, lb) characters in common, because the
# matched characters are a common sub-multiset and the transposition term is at most 1. So, with the
# characters of both texts in one global order, the two prefixes of length (own length - overlap + 1)
# share a character: the prefix filter. Pairs are split by their number of shared leading characters
# (0, 1, 2, or 3 and more), since that number fixes how strict the bound is, and by length class.
_CLASS_BASE = 1.25
_LEADING_CASES = {0: 0, 1: 1, 2: 2, 3: PREFIX_LENGTH}  # leading characters in the key: most that may be shared


def _length_class(n: int) -> int:
    return floor(log(n) / log(_CLASS_BASE) + 1e-9)


def _class_bounds(c: int) -> tuple[int, int]:
    low = ceil(_CLASS_BASE**c - 1e-9)
    high = ceil(_CLASS_BASE ** (c + 1) - 1e-9) - 1
    return max(1, low), high


def _rarity(text: str) -> list[str]:
    """Characters with their occurrence number, rarest first."""
    seen: dict[str, int] = {}
    tokens = []
    for ch in text:
        seen[ch] = seen.get(ch, 0) + 1
        rank = COMMON_LETTERS.find(ch.lower())
        tokens.append((-seen[ch], -(rank if rank >= 0 else 8), ch))
    tokens.sort()
    return [f"{ch}{-n}" for n, _, ch in tokens]


def signatures(text: str, threshold: float, left: bool) -> list[str]:
    """Join keys of one text; every pair of texts at or above ``threshold`` shares at least one."""
    n = len(text)
    if n == 0:
        return []
    keys = []
    tokens, own = _rarity(text), _length_class(n)
    for shared, most in _LEADING_CASES.items():
        if n < shared:
            continue
        bound = plain_bound(threshold, most)
        ratio = max(3 * bound - 2, 1e-9)  # least shorter/longer ratio
        share = 3 * bound - 1
        for other in range(_length_class(max(1, ceil(ratio * n - 1e-9))), _length_class(max(1, floor(n / ratio + 1e-9))) + 1):
            low, high = _class_bounds(other)
            low = max(low, ceil(ratio * n - 1e-9))
            if high < low:
                continue
            overlap = max(1, ceil(share * n * low / (n + low) - 1e-9))
            classes = f"{own}|{other}" if left else f"{other}|{own}"
            keys += [f"{shared}|{text[:shared]}|{classes}|{t}" for t in tokens[: max(0, n - overlap + 1)]]
    return keys


def signature_column(c: Column, threshold: float, left: bool) -> Column:
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: signatures(t or "", threshold, left))

    make.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(make, T.ArrayType(T.StringType()))(c)
