"""Many small groups at a time: rows of a sorted partition, their pairs, and where two rows first meet.

A group of its own task call costs a millisecond or two, more than most groups
take to compare; so a partition that is sorted by the group's key is read in
batches of whole groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def _changes(frame: pd.DataFrame, cell: list[str]) -> np.ndarray:
    """Rows after which another cell begins; column by column, so that no key loses digits."""
    out = np.zeros(max(0, len(frame) - 1), bool)
    for c in cell:
        v = frame[c].to_numpy()
        out |= v[1:] != v[:-1]
    return np.flatnonzero(out)


def by_cell(frames: Iterator[pd.DataFrame], cell: list[str]) -> Iterator[pd.DataFrame]:
    """Whole cells from a partition that is sorted by ``cell``, many at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        changes = _changes(frame, cell)
        if held and any(frame[c].iat[0] != held[-1][c].iat[-1] for c in cell):
            yield pd.concat(held, ignore_index=True)
            held = []
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            held = [frame.iloc[cut:]]
        else:
            held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def pairs(frame: pd.DataFrame, cell: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within each cell, some cells at a time; in a cell of two blocks, pairs across them."""
    starts = np.concatenate([[0], _changes(frame, cell) + 1, [len(frame)]])
    side = frame["side"].to_numpy()
    left, right, waiting = [], [], 0
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if side[a:b].any():
            i, j = a + np.flatnonzero(side[a:b] == 1), a + np.flatnonzero(side[a:b] == 2)
            p, q = np.repeat(i, len(j)), np.tile(j, len(i))
        else:
            p, q = np.triu_indices(b - a, 1)
            p, q = p + a, q + a
        left.append(p)
        right.append(q)
        waiting += len(p)
        if waiting > 100_000:
            yield np.concatenate(left), np.concatenate(right)
            left, right, waiting = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


def first_shared(lists: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The first node (in ascending order, 0 for none) that both rows' padded lists hold."""
    out = np.zeros(len(p), np.int64)
    open_ = np.arange(len(p))
    for col in range(lists.shape[1]):
        if not len(open_):
            break
        k = lists[p[open_], col]
        hit = (k != 0) & (lists[q[open_]] == k[:, None]).any(axis=1)
        out[open_[hit]] = k[hit]
        open_ = open_[~hit]
    return out


def padded(column: pd.Series) -> np.ndarray:
    width = max(map(len, column), default=0)
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out
