"""Personal data: base patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.tables import through_arrow
from tallyframe.llm.words import map_with_ids, pick, text_list

KINDS = ("email", "ip", "card", "phone")
# The base patterns, by kind.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Characters that a match of the kind cannot do without: texts without them are not searched.
_NEEDS = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile(r"[0-9][\x20-]?[0-9]"), "phone": re.compile(r"\+[0-9]")}
_LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
# A word that can be part of personal data; a plain word is always outside, so the chain falls into pieces between them.
_ODD = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGES = "\"'()[]{}<>,;:!?.*#$%&|"
_HASHED = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = "".join(c for c in found if c.isdigit()) if kind in ("card", "phone") else ""
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, kind by kind."""
    out = []
    for kind in KINDS:
        if _NEEDS[kind].search(text):
            out += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _passes(kind, m[0])]
    return out


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs of each cut to two; other characters as they are."""
    kinds = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", word))
    return re.sub(r"(.)\1+", r"\1\1", kinds)[:24]


def _check(digits: str) -> str:
    """Whether digits have the length and the check digit of a card."""
    return f"{16 <= len(digits) <= 19}{digits.isascii() and digits.isdigit() and luhn(digits)}"


def features(words: list[str], before: str, after: str) -> list[list[int]]:
    """Hashed features of each word of a piece: its shape, length and parts, and the shapes around it."""
    shapes = ["^" + shape(before), *map(shape, words), "$" + shape(after)]
    numbers = ["".join(c for c in w if c.isdigit()) for w in words]
    whole = _check("".join(n for n, w in zip(numbers, words) if not w.strip("0123456789-")))
    out = []
    for i, w in enumerate(words, 1):
        digits = sum(c.isdigit() for c in w)
        names = (f"s{shapes[i]}", f"d{min(digits, 20)}", f"l{min(len(w), 24)}", f"f{shape(w[:2])}", f"e{shape(w[-2:])}", f"p{shapes[i - 1]}|{shapes[i]}", f"n{shapes[i]}|{shapes[i + 1]}",
                 f"@{w.count('@')}.{min(w.count('.'), 4)}", f"+{w[:1] == '+'}{w[:1] == '('}", f"c{_check(numbers[i - 1])}", f"w{whole}",
                 f"o{all(int(x) < 256 for x in w.split('.') if x.isdigit() and x.isascii() and len(x) < 9)}{w.count('.')}", "b")
        out.append([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % _HASHED for x in names])
    return out


class Piece:
    """A run of odd words of a text, with its plain neighbours' shapes."""

    __slots__ = ("doc", "starts", "ends", "feats")

    def __init__(self, doc: int, spans: list[tuple[int, int]], text: str):
        self.doc = doc
        self.starts, self.ends = [], []
        for a, b in spans:  # punctuation around a word is not part of it, but a sign before a number is
            while b - a > 1 and text[b - 1] in _EDGES and text[b - 1] != ")":
                b -= 1
            while b - a > 1 and text[a] in _EDGES and text[a] != "(":
                a += 1
            self.starts.append(a)
            self.ends.append(b)
        low, high = spans[0][0], spans[-1][1]
        near = (_TOKEN.findall(text[max(0, low - 40) : low]) or [""])[-1], (_TOKEN.findall(text[high : high + 40]) or [""])[0]
        self.feats = features([text[a:b] for a, b in zip(self.starts, self.ends)], *near)


def pieces(doc: int, text: str) -> list[Piece]:
    if not re.search("[0-9@]", text):
        return []
    runs: list[list[tuple[int, int]]] = []
    for m in _ODD.finditer(text):
        if runs and len(runs[-1]) < 200 and text[runs[-1][-1][1] : m.start()].strip(" ") == "":
            runs[-1].append(m.span())
        else:
            runs.append([m.span()])
    return [Piece(doc, r, text) for r in runs]


def gold(piece: Piece, spans: list[tuple[str, int, int]]) -> list[int]:
    """Label numbers of a piece under known spans."""
    out = []
    for a, b in zip(piece.starts, piece.ends):
        hit = next(((k, s) for k, s, e in spans if s < b and a < e), None)
        out.append(0 if hit is None else _LABELS.index(("B-" if a <= hit[1] < b else "I-") + hit[0]))
    return out


class Field:
    """Weights of the chain: emissions by hashed feature, transitions between labels; plain words outside are label 0."""

    def __init__(self):
        n = len(_LABELS)
        self.emit = np.zeros((_HASHED, n))
        self.move = np.zeros((n, n))
        # A label that goes on can only follow the same kind.
        self.ban = np.zeros((n, n))
        for i, to in enumerate(_LABELS):
            if to.startswith("I-"):
                for j, of in enumerate(_LABELS):
                    if of[2:] != to[2:]:
                        self.ban[j, i] = -1e9

    def scores(self, group: list[Piece]) -> np.ndarray:
        """(piece, place, label) emission scores of pieces of equal length."""
        feats = np.array([p.feats for p in group])
        return self.emit[feats].sum(axis=2)

    def train(self, data: list[tuple[Piece, list[int]]], rounds: int = 60, rate: float = 0.5, pull: float = 1e-4) -> None:
        """Adaptive gradient ascent on the likelihood of the labels, by forward-backward over pieces of equal length."""
        by: dict[int, list] = {}
        for p, y in data:
            by.setdefault(len(y), []).append((p, y))
        groups = [([p for p, _ in g], np.array([y for _, y in g])) for _, g in sorted(by.items())]
        he, hm, total = np.full(self.emit.shape, 1e-8), np.full(self.move.shape, 1e-8), max(len(data), 1)
        n = len(_LABELS)
        for _ in range(rounds):
            ge, gm = np.zeros_like(self.emit), np.zeros_like(self.move)
            move = self.move + self.ban
            for ps, y in groups:
                s = self.scores(ps)
                count, length = y.shape
                alpha, beta = np.zeros((count, length, n)), np.zeros((count, length, n))
                alpha[:, 0] = s[:, 0] + move[0]
                for t in range(1, length):
                    alpha[:, t] = s[:, t] + _lse(alpha[:, t - 1][:, :, None] + move, 1)
                beta[:, -1] = move[:, 0]
                for t in range(length - 2, -1, -1):
                    beta[:, t] = _lse(move[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                z = _lse(alpha[:, -1] + move[:, 0], 1)
                p = np.exp(alpha + beta - z[:, None, None])
                want = np.eye(n)[y] - p
                feats = np.array([q.feats for q in ps])
                np.add.at(ge, feats.reshape(-1), np.repeat(want.reshape(-1, n), feats.shape[2], axis=0))
                gm[0] += want[:, 0].sum(axis=0)
                gm[:, 0] += want[:, -1].sum(axis=0)
                for t in range(1, length):
                    pair = np.exp(alpha[:, t - 1][:, :, None] + move + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
                    seen = np.zeros((n, n))
                    np.add.at(seen, (y[:, t - 1], y[:, t]), 1)
                    gm += seen - pair.sum(axis=0)
            ge, gm = ge / total - pull * self.emit, gm / total - pull * self.move
            he += ge**2
            hm += gm**2
            self.emit += rate * ge / np.sqrt(he)
            self.move += rate * gm / np.sqrt(hm)

    def decode(self, found: list[Piece]) -> list[list[int]]:
        """Viterbi paths, all pieces of a length at once."""
        out: list[list[int]] = [[]] * len(found)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(found):
            by.setdefault(len(p.feats), []).append(i)
        move = self.move + self.ban
        for length, idx in by.items():
            s = self.scores([found[i] for i in idx])
            best, back = s[:, 0] + move[0], []
            for t in range(1, length):
                step = best[:, :, None] + move
                back.append(step.argmax(axis=1))
                best = step.max(axis=1) + s[:, t]
            at = (best + move[:, 0]).argmax(axis=1)
            path = [at]
            for b in reversed(back):
                at = b[np.arange(len(idx)), at]
                path.append(at)
            for i, row in zip(idx, np.array(path[::-1]).T):
                out[i] = row.tolist()
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def labelled(docs: DataFrame, doc_id: str, text: str, sample_rows: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: up to ``sample_rows`` lines (by a hash) that hold a digit or an @, with their base spans."""
    lines = pick(docs, doc_id=doc_id, t=text).filter(F.col("t").rlike("[0-9]{3}|@")).select("doc_id", F.explode(F.split("t", "\n")).alias("line"))
    lines = lines.filter(F.col("line").rlike("[0-9]{3}|@")).select(F.substring("line", 1, 4000).alias("line")).distinct()
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(sample_rows).collect()  # at most sample_rows lines of 4,000 characters
    return [(r["line"], base_spans(r["line"])) for r in rows]


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 1500) -> Field:
    field, data = Field(), []
    for line, spans in labelled(docs, doc_id, text, sample_rows):
        data += [(p, gold(p, spans)) for p in pieces(0, line)]
    field.train(data)
    return field


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, spans that the field adds) of each text; an added span touches no base span."""
    base = [base_spans(t) for t in texts]
    found = [p for i, t in enumerate(texts) for p in pieces(i, t)]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for p, path in zip(found, field.decode(found)):
        i = 0
        while i < len(path):
            if path[i]:
                j, kind = i + 1, _LABELS[path[i]][2:]
                while j < len(path) and _LABELS[path[j]] == f"I-{kind}":
                    j += 1
                a, b = p.starts[i], p.ends[j - 1]
                if not any(s < b and a < e for _, s, e in base[p.doc]):
                    added[p.doc].append((kind, a, b))
                i = j
            else:
                i += 1
    return list(zip(base, added))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _batches(texts: list[str], rows: int = 200) -> Iterator[slice]:
    for i in range(0, len(texts), rows):
        yield slice(i, i + rows)


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", field: Field | None = None, **training) -> DataFrame:
    """One row per document: counts and digest of the base spans, all ``spans``, and ``n_added`` by the field.

    A conditional random field labels the words that hold a digit or an at sign; all other words are outside, so the
    chain is decoded exactly in the pieces between them. Features are the shapes of a word and its neighbours, hashed.
    The labelled table is a bounded sample of lines (``sample_rows``) with the spans of the base patterns, so the field
    generalises to what has the same shape and context and breaks the letter of a pattern. Added spans never overlap
    base ones. Positions are code points, ends exclusive. Pieces longer than 200 words are decoded 200 at a time.

    A null or empty text has no spans. Rows stand for themselves, repeated or not; an empty table gives no rows, and an
    empty labelled table a field that adds nothing.
    """
    field = field or train(docs, doc_id=doc_id, text=text, **training)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = text_list(b["t"])
            for part in _batches(texts):
                found = find(texts[part], field)
                out = {"doc_id": b["doc_id"].to_numpy()[part]}
                for k in KINDS:
                    out[f"n_{k}"] = [sum(s[0] == k for s in base) for base, _ in found]
                out["base_sha256"] = [hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in found]
                out["spans"] = [_join(base + added) for base, added in found]
                out["n_added"] = [len(added) for _, added in found]
                yield pd.DataFrame(out)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_with_ids(pick(docs, doc_id=doc_id, t=text), run, f"{counts}, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **training) -> DataFrame:
    """The rows of ``docs``, all columns, with personal data in the text replaced by its kind; null texts stay null."""
    field = train(docs, doc_id=doc_id, text=text, **training)

    def masked(place: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                given = b.column(place).to_pylist()
                texts = ["" if t is None else t for t in given]
                for part in _batches(texts):
                    made = [mask(t, base + added) if o is not None else None for o, t, (base, added) in zip(given[part], texts[part], find(texts[part], field))]
                    piece = b.slice(part.start, part.stop - part.start)
                    yield piece.set_column(place, b.schema.names[place], pa.array(made, b.schema.field(place).type))

        return run

    return through_arrow(docs, text, masked)
