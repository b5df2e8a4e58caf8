"""Words of whole texts in numpy batches, shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A word is a run of characters other than the space and the ASCII controls from tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Characters that a numpy step takes at once; one longer text makes a step of its own.
STEP_CHARS = 2_000_000
STEP_TEXTS = 65_536


def free(df_names: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (names differ by more than case)."""
    taken = {n.lower() for n in df_names}
    while name.lower() in taken:
        name += "_"
    return name


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns cannot clash with them."""
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for n, c in columns.items()])


def map_with_ids(df: DataFrame, run, schema: str) -> DataFrame:
    """``df`` through mapInPandas, with ``doc_id`` beside the columns of ``schema``.

    Whole-number ids pass pandas as texts, which keep all digits where the ids beside them are null.
    """
    kind = dict(df.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return df.mapInPandas(run, f"doc_id {kind}, {schema}")
    out = df.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def steps(texts: list[str], limit: int = STEP_CHARS) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` characters, and of no more texts than 16 bits can number."""
    low = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit or i - low >= STEP_TEXTS:
            yield slice(low, i)
            low, size = i, 0
        size += len(t)
    if low < len(texts):
        yield slice(low, len(texts))


class Words:
    """Words of some texts: ``code`` indexes ``unique``; ``doc`` is each word's text; ``counts`` words by text."""

    def __init__(self, texts: list[str], pattern: re.Pattern = WORD):
        found = [pattern.findall(t) for t in texts]
        self.counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        flat = np.empty(int(self.starts[-1]), dtype=object)
        flat[:] = list(chain.from_iterable(found))
        code, unique = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, object))
        self.code, self.unique = code.astype(np.int64), unique
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def by_word(self, of) -> np.ndarray:
        """``of(word)`` as a float for each word in place, computed once per distinct word."""
        return np.fromiter(map(of, self.unique), dtype=np.float64, count=len(self.unique))[self.code]

    def per_text(self, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc, values, minlength=len(self.counts))


def text_list(column: pd.Series) -> list[str]:
    """Texts as they are, null as the empty text."""
    return [t if isinstance(t, str) else "" for t in column]


_MASK = (1 << 64) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        factors = [np.full(size, np.uint64(m)) for m in (_MULTIPLIER, inverse)]
        for f in factors:
            f[0] = 1
        _POWERS[:] = [np.cumprod(f, dtype=np.uint64) for f in factors]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in order, index of its text); the same in every process."""
    hashes, doc, _, _ = placed_hashes([t.encode("utf-8", "replace") for t in texts])
    return hashes, doc


def placed_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of the words of texts in UTF-8; places are bytes of the text."""
    flat = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    space = _SPACE[flat]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(flat) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    powers, inverse = _powers(len(flat) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[flat] * powers[: len(flat)], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data])])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, doc, starts - offsets[doc], ends - offsets[doc]


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hash of every run of ``size`` words, index of its text), text by text; a shorter text with words is one run."""
    h, doc = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    key = np.zeros(len(h), np.uint64)
    last = len(h) - size + 1
    out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if last > 0:
        inside = np.flatnonzero(doc[:last] == doc[size - 1 :])
        key = h[inside]
        for i in range(1, size):
            key = mix(key * np.uint64(3) + h[inside + i])
        out, at = key >> np.uint64(16), doc[inside]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(n)])
        own = []
        for d in short:
            key = np.uint64(int(n[d]))
            for x in h[starts[d] : starts[d + 1]]:
                key = mix(np.array([key], np.uint64) * np.uint64(3) + x)[0]
            own.append(key >> np.uint64(16))
        out, at = np.concatenate([out, np.array(own, np.uint64)]), np.concatenate([at, short])
    return out, at


def weighted_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 48-bit hash, times) of the distinct shingles of up to 65,536 texts, sorted by text and hash."""
    h, doc = shingles(texts, size)
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | h)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), times
