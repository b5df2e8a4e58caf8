"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.words import Words, map_with_ids, pick, steps, text_list
from tallyframe.session import cut

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# Base rules: least words of a text, and the share of words in repeated windows that no text may pass, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW_WORDS = 3

FEATURES = ("word_length", "symbols", "capitals", "punctuation", "repeats", "variety")
P = len(FEATURES)
_PAIRS = list(combinations_with_replacement(range(P), 2))
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
# Width of a histogram bin of a statistic, and bins of a squared distance per doubling. Both bound the rows of a
# group by the range of the values, not by its size.
_VALUE_BIN, _BINS_PER_DOUBLING = 1 / 256, 16
# Least standard deviation of each statistic, as an added variance. Symbols, capitals and repeats are exactly zero in
# most texts of a clean group, whose covariance would be singular; a few of them are not yet an outlier.
_FLOOR = np.array([0.04, 0.08, 0.08, 0.04, 0.2, 0.02])


def counts(texts: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """(base counts, statistic vectors) of the texts."""
    base, vectors = [], []
    for part in steps(texts):
        some = texts[part]
        w = Words(some)
        n, chars = w.counts, w.per_text(w.by_word(len)).astype(np.int64)
        symbols = np.array([sum(map(t.count, SYMBOLS)) for t in some], dtype=np.int64)
        lines = [[x for x in t.split("\n") if x.strip("\x20\t\n\x0b\x0c\r")] for t in some]
        dup = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
        repeated = repeat_words(w)
        distinct = np.bincount(np.unique(w.doc * max(len(w.unique), 1) + w.code) // max(len(w.unique), 1), minlength=len(some))
        base.append(pd.DataFrame({"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated}))
        some_n = np.maximum(n, 1)
        angle = lambda k, of: np.arcsin(np.sqrt(np.clip(k / np.maximum(of, 1), 0, 1)))
        vectors.append(np.column_stack([
            np.log1p(chars / some_n),
            angle(symbols, chars),
            angle(w.per_text(w.by_word(lambda x: len(x) > 1 and x.isupper())), n),
            angle(w.per_text(w.by_word(lambda x: not x.isalnum())), n),
            angle(repeated, n),
            np.log1p(distinct) / np.log1p(some_n),
        ]))
    return pd.concat(base, ignore_index=True), np.vstack(vectors)


def repeat_words(w: Words) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more in it."""
    size = len(w.code)
    if size < WINDOW_WORDS:
        return np.zeros(len(w.counts), np.int64)
    # Windows as dense numbers, one word at a time, so that they stay exact; the text is the first part of the key.
    last = size - WINDOW_WORDS + 1
    key = w.doc[:last]
    for i in range(WINDOW_WORDS):
        key = pd.factorize(key * max(len(w.unique), 1) + w.code[i : i + last])[0]
    inside = w.doc[:last] == w.doc[WINDOW_WORDS - 1 :]
    key = np.where(inside, key, -1)
    often = inside & (np.bincount(key[inside], minlength=last)[key] > 1)
    covered = np.zeros(size, bool)
    for i in range(WINDOW_WORDS):
        covered[i : i + last] |= often
    return w.per_text(covered).astype(np.int64)


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: id, language and source (null as ''), base counts, ``v`` (statistic vector)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                base, v = counts(text_list(b["t"]))
                yield pd.concat([b[["doc_id", "lang", "source"]].reset_index(drop=True), base, pd.DataFrame({"v": list(v)})], axis=1)

    src = pick(docs, doc_id=doc_id, t=text, lang=lang, source=source)
    src = src.select("doc_id", "t", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    return map_with_ids(src, run, f"lang string, source string, {_BASE}, v array<double>")


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """Rows with the group ``g`` they are judged in.

    A language and source with too few rows joins the rest of its language, and a rest with too few rows joins the
    rest of the corpus.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    rest = Window.partitionBy("lang")
    small = F.col("n") < least
    sizes = sizes.withColumn("n_rest", F.sum(F.when(small, F.col("n")).otherwise(0)).over(rest))
    group = F.when(~small, F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source"))).when(
        F.col("n_rest") >= least, F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit("").alias("source"))
    ).otherwise(F.struct(F.lit(2).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source")))
    return rows.join(sizes.select("lang", "source", group.alias("g")), ["lang", "source"])


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile widths of each group, from histograms: the start of the search."""
    bins = rows.select("g", F.posexplode("v").alias("dim", "x")).groupBy(
        "g", "dim", F.floor(F.col("x") / _VALUE_BIN).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("g", "dim").orderBy("bin")
    bins = bins.select("g", "dim", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("g", "dim")).alias("all"))
    q = lambda share: (F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))) + 0.5) * _VALUE_BIN
    one = bins.groupBy("g", "dim").agg(q(0.5).alias("mid"), (q(0.75) - q(0.25)).alias("wide"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dim")
        scale = pdf["wide"].to_numpy() / 1.349
        return _estimates(pdf["g"].iloc[0], [(s, pdf["mid"].to_numpy(), np.diag(scale**2)) for s in (0, 1)])

    return cut(_per_group(one, solve))


def _per_group(df: DataFrame, solve) -> DataFrame:
    """``solve`` for each group; a group has a bounded number of rows here."""
    schema = "level int, lang string, source string, start int, mean array<double>, white array<double>, log_det double"
    flat = df.select(F.col("g.level").alias("level"), F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *[c for c in df.columns if c != "g"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(g=list(zip(pdf["level"], pdf["lang"], pdf["source"])))
        return solve(pdf)

    out = flat.groupBy("level", "lang", "source").applyInPandas(run, schema)
    return out.select(F.struct("level", "lang", "source").alias("g"), "start", "mean", "white", "log_det")


def _estimates(g: tuple, found: list) -> pd.DataFrame:
    rows = []
    for start, mean, cov in found:
        cov = cov + np.diag(_FLOOR**2)
        white = np.linalg.inv(np.linalg.cholesky(cov))
        rows.append((*g, start, mean.tolist(), white[np.tril_indices(P)].tolist(), float(np.linalg.slogdet(cov)[1])))
    return pd.DataFrame(rows, columns=["level", "lang", "source", "start", "mean", "white", "log_det"])


def _distance():
    """Squared Mahalanobis distance of ``v`` from ``mean`` under the lower triangle ``white``."""
    total, at = F.lit(0.0), 0
    for i in range(P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("white")[at] * (F.col("v")[j] - F.col("mean")[j])
            at += 1
        total = total + part * part
    return total


def _binned(rows: DataFrame, estimates: DataFrame, sums: bool) -> DataFrame:
    """Counts, and sums of values and products, per group, start and bin of the distance; combined before the shuffle."""
    d = F.floor(_BINS_PER_DOUBLING * F.log2(_distance() + 2.0**-20)).alias("bin")
    joined = rows.select("g", "v").join(estimates.select("g", "start", "mean", "white"), "g").select("g", "start", d, "v")
    found = [F.count(F.lit(1)).alias("n")]
    if sums:
        found += [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(P)]
        found += [F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"p{i}_{j}") for i, j in _PAIRS]
    return joined.groupBy("g", "start", "bin").agg(*found)


def _shares(n: np.ndarray, share: float) -> np.ndarray:
    """Weight of each bin, from near to far, so that the weights sum to ``share`` of the rows."""
    want = share * n.sum()
    before = np.concatenate([[0], np.cumsum(n)[:-1]])
    return np.clip((want - before) / np.maximum(n, 1), 0, 1)


def _concentrate(rows: DataFrame, estimates: DataFrame, shares: tuple[float, float]) -> DataFrame:
    """One concentration step: mean and covariance of the nearest share of each group's rows, for each start."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for start, p in pdf.sort_values(["start", "bin"]).groupby("start"):
            n = p["n"].to_numpy(float)
            w = _shares(n, shares[start])
            size = (w * n).sum()
            mean = np.array([(w * p[f"s{i}"]).sum() for i in range(P)]) / size
            cov = np.zeros((P, P))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = (w * p[f"p{i}_{j}"]).sum() / size - mean[i] * mean[j]
            low = np.linalg.eigvalsh(cov)[0]
            found.append((start, mean, cov + np.eye(P) * max(0.0, -low)))  # rounding may leave it a little negative
        return _estimates(pdf["g"].iloc[0], found)

    return cut(_per_group(_binned(rows, estimates, True), solve))


def chi_square(p: int, share: float) -> float:
    """Quantile of the chi-square distribution with ``p`` degrees of freedom, by bisection of its series."""
    from math import exp, lgamma, log

    def below(x: float) -> float:
        term = total = 1.0 / (p / 2)
        k = 1
        while term > 1e-16 * total:
            term *= x / 2 / (p / 2 + k)
            total += term
            k += 1
        return total * exp(-x / 2 + p / 2 * log(x / 2) - lgamma(p / 2))

    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return high


def reject_outliers(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                    share: float = 0.75, rounds: int = 5, least_rows: int = 60, confidence: float = 0.999) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``kept``, and ``distance``.

    Every document becomes a vector of statistics of its words on scales that are roughly normal. In each language and
    source, concentration steps look for the ``share`` of the rows whose covariance has the smallest determinant, from
    two starts around the medians, one of them tighter. A step is one aggregation of all rows into bins of the
    distance, so a group of any size meets in a bounded number of rows. The covariance is scaled so that the median
    distance is that of a normal population; ``kept`` is false beyond the ``confidence`` quantile of the chi-square
    distribution.

    A null text is empty; null languages and sources are groups of their own. Documents that fail the base rules take
    no part in the estimates and have no ``distance``. Groups of fewer than ``least_rows`` rows are judged with the
    rest of their language, then with the rest of the corpus; what is still too few keeps its rows (no distance).
    Repeated rows count each time; an empty table gives no rows.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = cut(statistics(docs, doc_id=doc_id, text=text, lang=lang, source=source).withColumn("base_failed", failed))
    rows = cut(_grouped(stats.filter(~F.col("base_failed")), least_rows))
    estimates = _start(rows)
    for i in range(rounds):
        estimates = _concentrate(rows, estimates, (share, 0.5 if i < 2 else share))
    best = estimates.groupBy("g").agg(F.min_by(F.struct("start", "mean", "white"), F.struct("log_det", "start")).alias("e"))
    best = cut(best.select("g", "e.*"))
    upto, whole = Window.partitionBy("g").orderBy("bin"), Window.partitionBy("g")
    bins = _binned(rows, best, False)
    bins = bins.select("g", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all"))
    mid = bins.filter(2 * F.col("upto") >= F.col("all")).groupBy("g").agg(F.min("bin").alias("mid"), F.max("all").alias("all"))
    scale = F.greatest(F.lit(1.0), F.pow(2.0, (F.col("mid") + 0.5) / _BINS_PER_DOUBLING) / chi_square(P, 0.5))
    judge = best.join(mid.filter(F.col("all") >= least_rows).select("g", scale.alias("scale")), "g")
    columns = ["doc_id", *[c.split()[0] for c in _BASE.split(", ")], "base_failed"]
    distance = (_distance() / F.col("scale")).alias("distance")
    judged = rows.join(judge.select("g", "mean", "white", "scale"), "g", "left").select(*columns, distance)
    out = judged.unionByName(stats.filter("base_failed").select(*columns, F.lit(None).cast("double").alias("distance")))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_square(P, confidence))
    return out.select(*columns, kept.alias("kept"), "distance")
