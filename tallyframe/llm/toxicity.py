"""Toxicity: a learned lexicon as a Levenshtein automaton, and context windows that tell quotation from abuse."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.automata import Lexicon
from tallyframe.llm.tables import through_arrow
from tallyframe.llm.words import map_with_ids, pick, steps, text_list

# Quotation marks that open and close.
OPENING, CLOSING = '"“„«‹‘`', '"”“»›’`'
_TOKEN = re.compile(r"\w+")
# A hit inside quotation marks, and a misspelled one, count this much; each further hit in its window adds to it.
_QUOTED, _NEAR, _COMPANY = 0.2, 0.6, 0.25


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never read: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each word with a number of its neighbours: a passage that many copies share counts once."""
    for b in batches:
        for t, toxic in zip(text_list(b["t"]), b["toxic"]):
            words = _TOKEN.findall(t.lower())
            if not words:
                continue
            around = zip(["", *words[:-1]], [*words[1:], ""])
            ctx = [zlib.crc32(f"{p} {n}".encode()) for p, n in around]
            yield pd.DataFrame({"word": words, "ctx": ctx, "toxic": bool(toxic)})


def learn_terms(rows: DataFrame, *, least: int = 5, precision: float = 0.95, stem_chars: int = 4, most_terms: int = 500) -> list[tuple[str, float]]:
    """Terms and stems (with ``*``) of toxic rows (t, toxic), with weights below 1.

    Evidence is the number of distinct neighbourhoods of a word in toxic and in other rows. A stem is a beginning that
    several words share and only toxic rows use; words that it leaves out are terms if their own evidence is enough.
    """
    words = rows.mapInPandas(_contexts, "word string, ctx long, toxic boolean").distinct().groupBy("word").agg(
        F.count(F.when(F.col("toxic"), 1)).alias("t"), F.count(F.when(~F.col("toxic"), 1)).alias("c"))
    parts = F.transform(F.sequence(F.lit(stem_chars), F.greatest(F.least(F.length("word"), F.lit(24)), F.lit(stem_chars))),
                        lambda n: F.substring(F.col("word"), F.lit(1), n))
    good = (F.col("t") >= least) & (F.col("t") >= precision * (F.col("t") + F.col("c")))
    begin = words.filter(F.length("word") >= stem_chars).select(F.explode(parts).alias("p"), "word", "t", "c").groupBy("p").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"), F.max_by("word", F.struct("t", "word")).alias("top"), F.max("t").alias("top_t"),
        F.count(F.when(F.col("t") > 0, 1)).alias("n"))
    # Bounded by most_terms: as many rows as a term has beginnings.
    stems = begin.filter(good).orderBy(F.desc("t"), "p").limit(24 * most_terms).collect()
    own = words.filter(good).orderBy(F.desc("t"), "word").limit(24 * most_terms).collect()
    by = {r["p"]: r for r in stems}
    terms: dict[str, float] = {}
    for p in sorted(by, key=lambda p: (len(p), p)):
        if any(p[:i] in by for i in range(stem_chars, len(p))):
            continue
        r = by[p]
        if r["top_t"] >= 0.9 * r["t"]:
            name = r["top"]
        elif r["n"] < 3:  # no stem; its words stand for themselves
            continue
        else:  # the longest beginning that nearly all its words share
            name = max((q for q in by if q.startswith(p) and by[q]["t"] >= 0.97 * r["t"]), key=len) + "*"
        terms[name] = r["t"] / (r["t"] + r["c"] + 3)
    for r in own:
        w = r["word"]
        if w not in terms and not any(w[:i] + "*" in terms for i in range(stem_chars, len(w) + 1)):
            terms[w] = r["t"] / (r["t"] + r["c"] + 3)
    best = sorted(terms, key=lambda x: (-terms[x], x))[:most_terms]
    return [(x, terms[x]) for x in sorted(best)]


class Scorer:
    """Evidence of abuse in texts, from hits of the lexicon and what stands around them."""

    def __init__(self, terms: list[tuple[str, float]], edits: int = 1, window: int = 60):
        self.weights = np.array([w for _, w in terms])
        self.lexicon, self.window = Lexicon([t for t, _ in terms], edits, least=4, fuzzy_stems=True), window
        self.ordinary: frozenset[str] = frozenset()
        self.curve = (-3.0, 4.0)

    def hits(self, texts: list[str]) -> Iterator[tuple[int, str, list[tuple[int, int, float, bool]]]]:
        """(index, lower-case text, hits (start, end, weight, near)) of the texts that have hits."""
        for part in steps(texts):
            low = [t.lower() for t in texts[part]]
            codes = np.frombuffer("\n".join(low).encode("utf-32-le", "replace"), dtype=np.uint32)
            if not len(codes):
                continue
            begin, end, term, near = self.lexicon.hits(codes)
            offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
            doc = np.searchsorted(offsets, begin, side="right") - 1
            for d in np.unique(doc):
                at = doc == d
                rows = zip(begin[at] - offsets[d], end[at] - offsets[d], self.weights[term[at]], near[at])
                text = low[d]
                yield part.start + int(d), text, [(int(a), int(b), float(w), bool(n)) for a, b, w, n in rows if not (n and text[a:b] in self.ordinary)]

    def quoted(self, text: str, start: int, end: int) -> bool:
        """Quotation marks open within the window before the hit and close within the window after it."""
        before, after = text[max(0, start - self.window) : start], text[end : end + self.window]
        open_at = max(before.rfind(c) for c in OPENING)
        if open_at < 0 or "\n" in before[open_at:]:
            return False
        opened = before[open_at]
        if opened in CLOSING and text.count(opened, text.rfind("\n", 0, start) + 1, start) % 2 == 0:
            return False  # that mark closed an earlier quotation
        shut = [after.find(c) for c in CLOSING if c in after]
        return bool(shut) and "\n" not in after[: min(shut)]

    def evidence(self, texts: list[str]) -> pd.DataFrame:
        out = pd.DataFrame({"evidence": np.zeros(len(texts)), "n_terms": np.zeros(len(texts), np.int64), "n_misspelled": np.zeros(len(texts), np.int64), "n_quoted": np.zeros(len(texts), np.int64)})
        for i, text, hits in self.hits(texts):
            starts = np.array([h[0] for h in hits])
            total, quoted = 0.0, 0
            for a, b, w, near in hits:
                company = int((np.abs(starts - a) <= self.window).sum()) - 1
                q = self.quoted(text, a, b)
                quoted += q
                total += w * (_NEAR if near else 1) * (_QUOTED if q else 1 + _COMPANY * min(company, 4))
            out.iloc[i] = [total, len(hits), sum(h[3] for h in hits), quoted]
        return out

    def calibrate(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic curve over log(1 + evidence), pulled to the prior curve where labels say nothing."""
        prior = np.array(self.curve)
        x = np.column_stack([np.ones(len(evidence)), np.log1p(evidence)])
        b = prior.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            pull = np.array([1.0, 1.0])  # as much as a few labelled rows
            grad = x.T @ (p - toxic) + pull * (b - prior)
            move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
            b = b - np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-9:
                break
        self.curve = (float(b[0]), float(max(b[1], 0.1)))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log1p(evidence), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_rows: int = 12_000, edits: int = 1) -> Scorer:
    """A scorer learned from at most ``sample_rows`` labelled rows (by a hash of the id), never from held-out ones.

    Three quarters of them give the lexicon, the rest the curve. Rows with a null label or id are no labels; of several
    labels of an id the larger counts.
    """
    y = pick(labels, doc_id=doc_id, toxic=toxic).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    y = y.withColumn("turn", order).orderBy("turn", "doc_id").limit(sample_rows)
    # At most sample_rows rows of three small columns.
    rows = pick(docs, doc_id=doc_id, t=text).join(F.broadcast(y), "doc_id")
    fit = F.pmod("turn", F.lit(4)) != 0
    scorer = Scorer(learn_terms(rows.filter(fit).select("t", "toxic")), edits)

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = text_list(b["t"])
            for _, t, hits in scorer.hits(texts):
                if found := sorted({t[a:e] for a, e, _, near in hits if near}):
                    yield pd.DataFrame({"word": found})

    # Words within an edit of a term, and beginnings within an edit of a stem, that clean rows use are ordinary, not
    # misspellings; at most one per edit of a term or stem.
    clean = rows.filter(~F.col("toxic") & fit).select("t").mapInPandas(spelled, "word string").distinct()
    scorer.ordinary = frozenset(r["word"] for r in clean.collect())

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"evidence": scorer.evidence(text_list(b["t"]))["evidence"].to_numpy(), "toxic": b["toxic"].to_numpy()})

    seen = rows.filter(~fit).select("t", "toxic").mapInPandas(measure, "evidence double, toxic boolean").toPandas()
    if len(seen):
        scorer.calibrate(seen["evidence"].to_numpy(float), seen["toxic"].to_numpy(float))
    return scorer


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, scorer: Scorer | None = None, **training) -> DataFrame:
    """One row per document: ``held_out``, ``score`` (0 to 1), ``predicted``, and the counts behind them.

    Words and stems that only toxic labelled rows use form a lexicon. Its trie, intersected with the Levenshtein
    automaton of one edit, runs over every word of every whole text: terms of four letters or more and the letters of
    stems take the edit, shorter terms count unchanged only. A misspelled term counts less, and one that clean rows know
    as another word, or as the beginning of other words, does not count. In a window around each hit, quotation marks lower its weight and
    other hits raise it. A logistic curve learned from further labelled rows turns the evidence into the score.

    A null or empty text has no evidence: the lowest score. Repeated rows are scored each; an empty table gives no
    rows; without labels the lexicon is empty and the prior curve holds. Neither labels, language nor source of a
    document enter its score.
    """
    scorer = scorer or train(docs, labels, doc_id=doc_id, text=text, **training)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                e = scorer.evidence(text_list(b["t"]))
                s = scorer.score(e["evidence"].to_numpy())
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "score": s, "predicted": (s >= threshold).astype("int32"), "n_terms": e["n_terms"].astype("int64").to_numpy(), "n_misspelled": e["n_misspelled"].astype("int64").to_numpy(), "n_quoted": e["n_quoted"].astype("int64").to_numpy()})

    out = map_with_ids(pick(docs, doc_id=doc_id, t=text), run, "score double, predicted int, n_terms long, n_misspelled long, n_quoted long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_terms", "n_misspelled", "n_quoted")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, **training) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic; scored in place, without a join."""
    scorer = train(docs, labels, doc_id=doc_id, text=text, **training)

    def clean(place: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    texts = ["" if t is None else t for t in b.column(place).to_pylist()]
                    yield b.filter(pa.array(scorer.score(scorer.evidence(texts)["evidence"].to_numpy()) < threshold))

        return run

    return through_arrow(docs, text, clean)
