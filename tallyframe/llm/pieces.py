"""N-best piece segmentation: exact forward scores guide a backward A-star search over the piece lattice."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyframe.llm.words import map_with_ids, mix, pick, steps, text_list

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
# No piece goes on after a blank that follows something else, or over a line end: the lattice falls into these units.
_UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_STEP_CHARS, _CELLS = 6_000_000, 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Pieces with scores. A character that no piece holds is spelled by its bytes, at a penalty below every score."""

    def __init__(self, pieces: list[tuple[int, str, float]], bytes_of: list[int]):
        if any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for _, p, _ in pieces):
            raise ValueError("a piece crosses a word end")
        self.ids = {p: i for i, p, _ in pieces}
        self.score = {p: s for _, p, s in pieces}
        self.text = {i: p for i, p, _ in pieces}
        self.bytes_of, self.byte_of = bytes_of, {b: i for i, b in enumerate(bytes_of)}
        self.longest = max((len(p) for _, p, _ in pieces), default=1)
        self.missing = min((s for _, _, s in pieces if s > -1e8), default=0.0) - 10
        names = [p for _, p, _ in pieces]
        keys = np.array([self._key(p) for p in names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.ids[p] for p in names], np.int64)[order]
        self.key_scores = np.array([self.score[p] for p in names])[order]
        self.bit = np.zeros(1 << 20, bool)
        self.bit[(mix(keys) >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        spelled = sorted((m.id_to_piece(i), i) for i in range(size) if m.is_byte(i))
        return cls([(i, m.id_to_piece(i), m.get_score(i)) for i in plain], [i for _, i in spelled])

    @staticmethod
    def _key(piece: str) -> int:
        k = 0
        for c in piece:
            k = (k * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return k

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, score or -inf) of substrings by their keys."""
        flat = keys.reshape(-1)
        ids, scores = np.full(len(flat), -1, np.int64), np.full(len(flat), -np.inf)
        maybe = np.flatnonzero(self.bit[(mix(flat) >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, flat[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == flat[maybe]
        ids[maybe[ok]], scores[maybe[ok]] = self.key_ids[at[ok]], self.key_scores[at[ok]]
        return ids.reshape(keys.shape), scores.reshape(keys.shape)

    def edges(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For lengths 1, 2, ...: (ids, scores) of the pieces from each place of units of equal length (rows)."""
        out, key = [], np.zeros(codes.shape, np.uint64)
        size = codes.shape[1]
        for n in range(1, min(self.longest, size) + 1):
            key = key[:, : size - n + 1] * _BASE + codes[:, n - 1 :] + np.uint64(1)
            ids, scores = self.look_up(key)
            if n == 1:
                none = ids < 0
                scores[none] = self.missing
            out.append((ids, scores))
        return out

    def spell(self, char: str) -> list[int]:
        return [self.bytes_of[b] for b in char.encode("utf-8", "replace")]

    def decode(self, ids: list[int]) -> str:
        """Text of piece ids, with spaces for blanks and without the blank put before the text."""
        return self.joined(ids).replace(BLANK, " ").removeprefix(" ")

    def joined(self, ids: list[int]) -> str:
        """Pieces of ids in a row; runs of byte pieces are read as UTF-8."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.text[i])
        return "".join(out) + held.decode("utf-8", "replace")

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """(best score, loss of the second best or inf, ids of the best) of each unit, all of a length at once."""
        best, loss, ids = np.zeros(len(units)), np.full(len(units), np.inf), [[]] * len(units)
        by: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by.setdefault(len(u), []).append(i)
        for size, group in by.items():
            rows = max(1, _CELLS // (size * 4))
            for low in range(0, len(group), rows):
                part = group[low : low + rows]
                codes = np.frombuffer("".join(units[i] for i in part).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64).reshape(len(part), size)
                b, s, paths = self._segment(codes)
                best[part], loss[part] = b, s
                for i, p in zip(part, paths):
                    ids[i] = [x for pos, n, piece in p for x in ([piece] if piece >= 0 else self.spell(units[i][pos : pos + n]))]
        return best, loss, ids

    def _segment(self, codes: np.ndarray):
        count, size = codes.shape
        edges = self.edges(codes)
        forward, backward = np.full((count, size + 1), -np.inf), np.full((count, size + 1), -np.inf)
        forward[:, 0] = backward[:, size] = 0.0
        choice = np.zeros((count, size + 1), np.int64)
        for j in range(1, size + 1):
            options = np.stack([forward[:, j - n] + edges[n - 1][1][:, j - n] for n in range(1, min(len(edges), j) + 1)], axis=1)
            choice[:, j] = options.argmax(axis=1) + 1
            forward[:, j] = options.max(axis=1)
        for j in range(size - 1, -1, -1):
            options = [backward[:, j + n] + edges[n - 1][1][:, j] for n in range(1, min(len(edges), size - j) + 1)]
            backward[:, j] = np.maximum.reduce(options)
        totals = [forward[:, : size - n + 1] + e[1] + backward[:, n:] for n, e in enumerate(edges, 1)]
        at, row = np.full(count, size), np.arange(count)
        trail = []
        while (at > 0).any():
            live = row[at > 0]
            n = choice[live, at[live]]
            begin = at[live] - n
            piece = np.full(len(live), -1, np.int64)
            for m in np.unique(n):
                on = n == m
                piece[on] = edges[m - 1][0][live[on], begin[on]]
                totals[m - 1][live[on], begin[on]] = -np.inf
            trail.append((live, begin, n, piece))
            at[live] = begin
        second = np.maximum.reduce([t.max(axis=1) for t in totals])
        paths: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
        for live, begin, n, piece in reversed(trail):
            for r, b, m, p in zip(live.tolist(), begin.tolist(), n.tolist(), piece.tolist()):
                paths[r].append((b, m, p))
        return forward[:, size], forward[:, size] - second, paths

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations (loss against the best, ids) of a unit, best first.

        Paths grow from the end of the unit. A path's priority is its own score plus the best forward score of the place
        it has reached, which is exactly what its best completion has, so paths leave the queue in order of their final
        scores. Of equal priorities the path that is nearest to the start goes on, so ties do not
        fan out.
        """
        size = len(unit)
        into: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(size + 1)]
        forward = [0.0] + [-np.inf] * size
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                piece = unit[i:j]
                if piece in self.ids:
                    into[j].append((i, self.score[piece], [self.ids[piece]]))
                elif j - i == 1:
                    into[j].append((i, self.missing, self.spell(piece)))
            forward[j] = max(forward[i] + s for i, s, _ in into[j])
        # A path is a chain (ids, the path after it), so that growing it copies nothing.
        queue: list[tuple] = [(-forward[size], size, 0, 0.0, None)]
        turn, out = 0, []
        while queue and len(out) < n:
            f, at, _, g, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((forward[size] + f, ids))
                continue
            for i, s, own in into[at]:
                turn += 1
                heapq.heappush(queue, (-(g + s + forward[i]), i, turn, g + s, (own, path)))
        return out


def encode(texts: list[str], pieces: Pieces, n: int, cache: dict) -> list[dict]:
    """Best ids and the ``n`` best totals of each text, with the units in which each alternative differs."""
    out = []
    for part in steps(texts, _STEP_CHARS):
        units = [_UNIT.findall((BLANK + t).replace(" ", BLANK)) if t else [] for t in texts[part]]
        flat = np.array([u for us in units for u in us] + [None], dtype=object)[:-1]
        code, distinct = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, object))
        best, loss, ids = pieces.segment(list(distinct))
        counts = np.array([len(x) for x in ids], np.int64)
        named = [",".join(map(str, x)) for x in ids]
        back = np.array([pieces.joined(x) == u for x, u in zip(ids, distinct)], bool)
        low = 0
        for us in units:
            own = code[low : low + len(us)]
            low += len(us)
            near = loss[own]
            few = np.argsort(near, kind="stable")[: n - 1]
            # Only the n - 1 units with the closest second choice can differ in one of the n best of the text.
            totals: list[tuple[float, tuple]] = [(0.0, ())]
            for place in sorted(few[np.isfinite(near[few])].tolist()):
                u = us[place]
                if (u, n) not in cache:
                    if len(cache) > 200_000:
                        cache.clear()
                    cache[u, n] = pieces.n_best(u, n)
                ways = [(d, ((place, i),) if i else ()) for i, (d, _) in enumerate(cache[u, n])]
                totals = heapq.nsmallest(n, [(a + d, x + w) for a, x in totals for d, w in ways])
            out.append({
                "n_pieces": int(counts[own].sum()), "score": float(best[own].sum()), "losses": [t for t, _ in totals],
                "changes": [[(p, us[p], cache[us[p], n][i][1]) for p, i in w] for _, w in totals],
                "ids": ",".join([named[c] for c in own.tolist()]), "decoded": bool(back[own].all()),
            })
    return out


def encode_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, n: int = 4, with_ids: bool = False) -> DataFrame:
    """One row per document: pieces and score of the best segmentation, the ``n`` best losses, and what they change.

    ``losses`` are the scores of the n best segmentations of the whole text below the best one; ``changes`` lists, for
    each, unit:ids of the units that differ, in order. ``ids_sha256`` is over the comma-joined ids of the best one, which
    ``with_ids`` returns. ``decoded`` says whether the pieces of every unit give its characters back.

    No piece crosses a word end, so the lattice of a text falls into units and its n best follow exactly from the n best
    of the n - 1 units whose second choice costs least. Forward scores of all distinct units of a batch are computed
    together; the A-star search runs on those few units.

    A null or empty text has no pieces, score 0 and one empty segmentation. Rows stand for themselves; an empty table
    gives no rows. The pieces of the model (a bounded table) travel with the plan.
    """
    pieces = Pieces.load(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for b in batches:
            texts = text_list(b["t"])
            for low in range(0, len(texts), 2000):
                some = texts[low : low + 2000]
                found = encode(some, pieces, n, cache)
                out = {"doc_id": b["doc_id"].to_numpy()[low : low + 2000]}
                for c in ("n_pieces", "score", "losses"):
                    out[c] = [f[c] for f in found]
                out["changes"] = [[" ".join(f"{p}:{'.'.join(map(str, i))}" for p, _, i in c) for c in f["changes"]] for f in found]
                out["ids_sha256"] = [hashlib.sha256(f["ids"].encode()).hexdigest() for f in found]
                out["decoded"] = [f["decoded"] for f in found]
                if with_ids:
                    out["ids"] = [list(map(int, f["ids"].split(","))) if f["ids"] else [] for f in found]
                yield pd.DataFrame(out)

    more = ", ids array<int>" if with_ids else ""
    return map_with_ids(pick(docs, doc_id=doc_id, t=text), run, f"n_pieces long, score double, losses array<double>, changes array<string>, ids_sha256 string, decoded boolean{more}")
