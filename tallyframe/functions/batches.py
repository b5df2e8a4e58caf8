"""Whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each group in a stream sorted by ``keys``; holds one group and one batch at most."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if batch.empty:
            continue
        arrays = {c: batch[c].to_numpy() for c in batch.columns}
        change = np.zeros(len(batch), dtype=bool)
        for k in keys:
            change[1:] |= arrays[k][1:] != arrays[k][:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for low, high in zip(bounds, bounds[1:]):
            piece = {c: a[low:high] for c, a in arrays.items()}
            if held and any(held[0][k][0] != piece[k][0] for k in keys):
                yield joined()
                held = []
            held.append(piece)
    if held:
        yield joined()


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of runs of whole groups in a stream sorted by ``key``; holds one group and one batch at most."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if batch.empty:
            continue
        arrays = {c: batch[c].to_numpy() for c in batch.columns}
        keys = arrays[key]
        before = held[-1][key][-1] if held else None
        new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        last = int(new[-1]) if len(new) else 0
        if held and before != keys[0] and not last:
            yield joined()
            held = []
        elif last:
            # The group before ends in this batch, or has ended; all groups but the last are whole.
            held.append({c: v[:last] for c, v in arrays.items()})
            yield joined()
            held = []
        held.append({c: v[last:] for c, v in arrays.items()})
    if held:
        yield joined()
