"""Levenshtein automaton of a whole lexicon: its trie, intersected with every text within an edit, as one table."""

from __future__ import annotations

import numpy as np

# Characters of a word: letters, digits and the underscore of the basic plane.
_IN_WORD = np.zeros(0x110000 + 1, dtype=bool)
_IN_WORD[:0x10000] = [chr(i).isalnum() or i == 95 for i in range(0x10000)]


class Lexicon:
    """Terms as a deterministic automaton that accepts a word within ``edits`` of a term.

    A term that ends in ``*`` is a stem: it accepts every word that begins with it, unchanged; with ``fuzzy_stems`` also
    every word that begins within ``edits`` of it. Terms and stems of fewer than ``least`` characters are accepted
    unchanged only. The states are sets of (trie node, edits spent), built for the
    lexicon once, so that a word costs one table look-up per character and stops at the first dead state.
    """

    def __init__(self, terms: list[str], edits: int = 1, least: int = 5, fuzzy_stems: bool = False):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        stems: dict[int, int] = {}
        for t, term in enumerate(terms):
            node = 0
            for c in term.removesuffix("*"):
                if c not in children[node]:
                    children.append({})
                    children[node][c] = len(children) - 1
                node = children[node][c]
            (stems if term.endswith("*") else ends)[node] = t
        letters = sorted({c for node in children for c in node})
        # Nodes below which a term may be reached by an edit; others are not worth a state.
        fuzzy = [False] * len(children)
        for term in terms:
            plain = term.removesuffix("*")
            if (fuzzy_stems or plain == term) and len(plain) >= least:
                node = 0
                fuzzy[0] = True
                for c in plain:
                    node = children[node][c]
                    fuzzy[node] = True

        def closed(states: set) -> frozenset:
            todo = list(states)
            while todo:
                node, e = todo.pop()
                if e < edits:
                    for child in children[node].values():  # a character of the term is missing
                        if fuzzy[child] and (child, e + 1) not in states:
                            states.add((child, e + 1))
                            todo.append((child, e + 1))
            best: dict[int, int] = {}
            for node, e in states:
                best[node] = min(e, best.get(node, e))
            return frozenset(best.items())

        def step(state: frozenset, c: str | None) -> frozenset:
            out = set()
            for node, e in state:
                if c in children[node] and (not e or fuzzy[children[node][c]]):
                    out.add((children[node][c], e))
                if e < edits and fuzzy[node]:
                    out.add((node, e + 1))
                    out |= {(child, e + 1) for child in children[node].values() if fuzzy[child]}
            return closed(out)

        start = closed({(0, 0)})
        number, rows, queue = {frozenset(): 0, start: 1}, [[0] * (len(letters) + 1)], [start]
        for state in queue:  # grows while it is read
            row = []
            for c in [None, *letters]:
                to = step(state, c)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                row.append(number[to])
            rows.append(row)
        self.next = np.array(rows, dtype=np.int32)
        size = len(number)
        self.exact, self.near, self.stem, self.near_stem = (np.full(size, -1, np.int32) for _ in range(4))
        for state, k in number.items():
            for node, e in sorted(state):
                if e == 0 and node in ends:
                    self.exact[k] = ends[node]
                elif e and node in ends and len(terms[ends[node]]) >= least and self.near[k] < 0:
                    self.near[k] = ends[node]
                if e == 0 and node in stems:
                    self.stem[k] = stems[node]
                elif e and fuzzy_stems and node in stems and len(terms[stems[node]]) > least and self.near_stem[k] < 0:
                    self.near_stem[k] = stems[node]
        self.letter = np.zeros(0x110000 + 1, np.int16)
        for i, c in enumerate(letters):
            self.letter[ord(c)] = i + 1

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, term, is_near) of the words of ``codes`` (code points of lower-case text) that are accepted."""
        word = _IN_WORD[codes]
        starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        codes = np.append(codes, 0)
        word = np.append(word, False)
        cls = self.letter[codes]
        found: list[tuple[np.ndarray, ...]] = []
        at, begin, state = starts.copy(), starts, np.ones(len(starts), np.int32)
        # A word that began within an edit of a stem counts as misspelled, up to there, unless it is accepted otherwise.
        likely, open_word, until = np.full(len(starts), -1, np.int32), np.ones(len(starts), bool), starts.copy()
        which = np.arange(len(starts))
        while len(at):
            ended = ~word[at]
            if ended.any():
                s = state[ended]
                for table, near in ((self.exact, False), (self.near, True)):
                    ok = table[s] >= 0 if not near else (table[s] >= 0) & (self.exact[s] < 0)
                    found.append((begin[ended][ok], at[ended][ok], table[s][ok], np.full(ok.sum(), near)))
                    open_word[which[ended][ok]] = False
                at, begin, state, which = at[~ended], begin[~ended], state[~ended], which[~ended]
            state = self.next[state, cls[at]]
            at = at + 1
            stem = self.stem[state] >= 0
            if stem.any():
                found.append((begin[stem], at[stem], self.stem[state[stem]], np.zeros(stem.sum(), bool)))
                open_word[which[stem]] = False
            begun = (self.near_stem[state] >= 0) & (likely[which] < 0)
            likely[which[begun]], until[which[begun]] = self.near_stem[state[begun]], at[begun]
            alive = (state > 0) & ~stem
            at, begin, state, which = at[alive], begin[alive], state[alive], which[alive]
        begun = open_word & (likely >= 0)
        if begun.any():
            found.append((starts[begun], until[begun], likely[begun], np.ones(begun.sum(), bool)))
        if not found:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32), np.zeros(0, bool))
        begin, end, term, near = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(begin, kind="stable")
        return begin[order], end[order], term[order], near[order]
