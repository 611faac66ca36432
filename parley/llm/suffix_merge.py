"""Repeated stretches in a set of byte strings, by merging the Burrows-Wheeler transforms of shards.

Strings are read as sequences of overlapping byte groups: the symbol at a place is its group of
``GROUP`` bytes, and the next symbol of the same sequence is ``GROUP`` bytes on. Each shard of strings
has its own suffix order and transform. The transforms are merged by refining one interleave: it
starts with the shards one after the other, and each round sends every row to the place of the suffix
one symbol longer. After ``d`` rounds suffixes are ordered by their first ``d`` symbols, and rows whose
block was never cut share a prefix of ``d`` symbols. No suffix is sorted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from parley.llm import words

#: Bytes of one symbol, and shards of which the transforms are merged.
GROUP, SHARDS = 25, 4


@dataclass
class Shard:
    """Suffix order of some strings (as rows of the whole set) and the symbol before each suffix."""

    order: np.ndarray
    before: np.ndarray


def named(codes: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the byte groups at ``at``: equal exactly if the bytes are, also where hashes collide."""
    name = np.unique(codes, return_inverse=True)[1]
    first = np.empty(len(at), np.int64)
    first[name] = at
    groups = np.lib.stride_tricks.sliding_window_view(raw, GROUP)
    if (groups[at] == groups[first[name]]).all():
        return name
    return np.unique(groups[at], axis=0, return_inverse=True)[1].reshape(-1)


def _sorted_shard(symbol: np.ndarray, after: np.ndarray, rows: np.ndarray, previous: np.ndarray) -> Shard:
    """Rank doubling over ``rows``; ``after`` is the next row of the same sequence, or -1 at its end."""
    place = np.full(len(symbol) + 1, -1)
    place[rows] = np.arange(len(rows))
    own, step = symbol[rows], place[after[rows]]
    ends = own == 0
    rank = np.where(ends, np.cumsum(ends) - 1, own + int(ends.sum()))
    n = len(rows)
    top = int(rank.max()) + 2
    while True:
        key = rank * top + np.where(step >= 0, rank[step] + 1, 0)
        order = np.argsort(key)
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = fresh
        if rank[order[-1]] == n - 1:
            return Shard(rows[order], previous[rows[order]])
        step, top = np.where(step >= 0, step[step], -1), n + 1


def _interleave(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all shards in the merged order of their first ``rounds`` symbols, and their blocks."""
    before = np.concatenate([s.before for s in shards])
    small = np.uint16 if before.max(initial=0) < 1 << 16 else np.int64
    before = before.astype(small)
    origin = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.order) for s in shards])
    ends = np.sort(origin[before == 0])
    block = np.zeros(len(origin), np.int64)
    for _ in range(rounds):
        seat = np.argsort(origin, kind="stable")
        here = np.empty_like(before)
        here[seat] = before
        move = np.argsort(here, kind="stable")
        here, came = here[move], block[move]
        fresh = (here[1:] != here[:-1]) | (came[1:] != came[:-1])
        fresh[: len(ends)] = True
        block = np.concatenate(([0], np.cumsum(fresh)))
        origin = origin[move]
        origin[: len(ends)] = ends
    rows = np.empty(len(origin), np.int64)
    rows[np.argsort(origin, kind="stable")] = np.concatenate([s.order for s in shards])
    return rows, block


def repeated(strings: list[bytes], weight: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string the starts of the ``length``-byte stretches that occur twice or more in all.

    A string counts ``weight`` times. ``length`` must be a multiple of ``GROUP``.
    """
    sizes = np.array([len(s) for s in strings])
    # a row for each place of a string and one past it; the last GROUP of them hold no whole symbol
    first = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    at = np.arange(total) - first[owner]
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    whole = np.flatnonzero(at + GROUP <= sizes[owner])
    up, down = words.powers(total + 1)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:total], out=sums[1:])
    symbol = np.zeros(total, np.int64)
    symbol[whole] = named((sums[whole + GROUP] - sums[whole]) * down[whole], raw, whole) + 1
    after = np.full(total, -1)
    after[whole] = whole + GROUP
    previous = np.zeros(total, np.int64)
    previous[whole + GROUP] = symbol[whole]
    cuts = np.linspace(0, len(strings), min(SHARDS, len(strings)) + 1).astype(int)
    spans = [np.arange(first[a], first[b - 1] + sizes[b - 1] + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rows, block = _interleave([_sorted_shard(symbol, after, own, previous) for own in spans], length // GROUP)
    often = np.bincount(block, weight[owner[rows]]) >= 2
    hit = np.sort(rows[often[block]])
    hit = hit[at[hit] + length <= sizes[owner[hit]]]
    ends = np.searchsorted(owner[hit], np.arange(len(strings) + 1))
    return [at[hit[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
