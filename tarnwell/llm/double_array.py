"""Double-array tries built and walked with numpy.

A state is a place in two arrays: from state s the symbol c leads to t = base[s] + c if check[t] = s.
Keys are byte strings. They are put in level by level, all keys at once; then every node's symbols
get a base at which their places are free: nodes with many symbols first, in windows of their own,
then nodes with some at random bases for all of them at once, and last single symbols, which fit
anywhere. Walks advance all texts' positions by one symbol at a time and drop those that leave the trie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALPHABET = 256
DIGIT = 6  # bits of a number's digit; numbers are keys of few symbols, so that nodes are narrow
TRIES = 40


@dataclass(frozen=True)
class DoubleArray:
    """base, check, accept: int32 by state; accept: the key's place or -1. State 0 is the root."""

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, whether there is one) of each state and symbol."""
        to = self.base[state] + symbol
        return to, self.check[to] == state

    def after(self, key: bytes) -> int:
        """The state after ``key`` or -1."""
        state = 0
        for c in key:
            to = int(self.base[state]) + c
            if self.check[to] != state:
                return -1
            state = to
        return state

    def strings(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, root: int = 0) -> np.ndarray:
        """What each span of ``data`` is accepted as from the state ``root`` on, or -1."""
        out = np.full(len(start), -1, np.int32)
        rows, state, at = np.arange(len(start)), np.full(len(start), root, np.int32), start
        while len(rows):
            over = at == end[rows]
            out[rows[over]] = self.accept[state[over]]
            rows, state, at = rows[~over], state[~over], at[~over]
            state, ok = self.step(state, data[at].astype(np.int32))
            rows, state, at = rows[ok], state[ok], at[ok] + 1
        return out

    def windows(self, ids: np.ndarray, size: int, digits: int) -> np.ndarray:
        """What the ``size`` numbers from each place of ``ids`` on are accepted as, or -1; a 0 among them ends a walk."""
        out = np.full(len(ids), -1, np.int32)
        rows, hit = self.places(ids, size, digits)
        out[rows] = hit
        return out

    def places(self, ids: np.ndarray, size: int, digits: int, first: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, accepted as or -1) of walks of ``size`` numbers that stay in the trie; first: only from numbers of this range on, ends included."""
        starts = ids[: max(0, len(ids) - size + 1)]
        rows = np.flatnonzero(starts > 0 if first is None else (starts >= max(1, first[0])) & (starts <= first[1]))
        state = np.zeros(len(rows), np.int32)
        for k in range(size):
            number = ids[rows + k]
            for shift in range(DIGIT * (digits - 1), -1, -DIGIT):
                state, ok = self.step(state, (number >> shift) & ((1 << DIGIT) - 1))
                ok &= number > 0
                rows, state, number = rows[ok], state[ok], number[ok]
        return rows, self.accept[state]


def digits_of(ids: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of the keys of rows of numbers, the highest digit first."""
    shifts = np.arange(DIGIT * (digits - 1), -1, -DIGIT)
    symbols = ((ids[:, :, None] >> shifts) & ((1 << DIGIT) - 1)).astype(np.uint8)
    return symbols.ravel(), np.arange(len(ids) + 1, dtype=np.int64) * (ids.shape[1] * digits)


def build(symbols: np.ndarray, offsets: np.ndarray) -> DoubleArray:
    """The trie of the distinct keys symbols[offsets[i] : offsets[i + 1]]."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    node, nodes, left = np.zeros(len(size), np.int64), 1, len(size)
    parents, labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for depth in range(int(size.max(initial=0))):
        while size[order[left - 1]] <= depth:
            left -= 1
        rows = order[:left]
        edge, which = np.unique(node[rows] * ALPHABET + symbols[offsets[rows] + depth], return_inverse=True)
        parents.append(edge // ALPHABET)
        labels.append(edge % ALPHABET)
        node[rows] = nodes + which
        nodes += len(edge)
    parent, label = np.concatenate(parents), np.concatenate(labels)  # edge i leads to node i + 1; parents ascend
    base = _bases(parent, label, nodes)
    place = np.zeros(nodes, np.int64)
    place[1:] = base[parent] + label
    length = int(place.max()) + ALPHABET + 1
    out = DoubleArray(np.zeros(length, np.int32), np.full(length, -1, np.int32), np.full(length, -1, np.int32))
    out.base[place] = base
    out.check[place[1:]] = place[parent]
    out.accept[place[node]] = np.arange(len(size))
    return out


def _bases(parent: np.ndarray, label: np.ndarray, nodes: int) -> np.ndarray:
    """Of each node a base at which its children's places are free and taken by no other node."""
    base = np.zeros(nodes, np.int64)
    if not len(parent):
        return base
    owner, first, width = np.unique(parent, return_index=True, return_counts=True)
    span = int(label.max()) + 1
    free = np.ones(3 * len(parent) + 4 * ALPHABET, bool)
    free[0] = False  # the root
    end = 1  # from here on nothing is taken by windows

    def windows(which: np.ndarray) -> None:
        nonlocal end, free
        need = end + span * len(which) + ALPHABET
        if need > len(free):
            free = np.concatenate([free, np.ones(need - len(free), bool)])
        base[owner[which]] = end + span * np.arange(len(which))
        edge = _edges(first[which], width[which])
        free[base[parent[edge]] + label[edge]] = False
        end += span * len(which)

    wide = min(64, span // 4 + 2)
    windows(np.flatnonzero(width >= wide))
    random = np.random.default_rng(1)
    for least in (32, 16, 8, 4, 2):
        open_ = np.flatnonzero((width >= least) & (width < min(2 * least, wide)))
        for _ in range(TRIES):
            if not len(open_):
                break
            at = random.integers(1, len(free) - ALPHABET, len(open_))
            edge = _edges(first[open_], width[open_])
            who = np.repeat(np.arange(len(open_)), width[open_])
            slot = at[who] + label[edge]
            claim = np.full(len(free), -1, np.int32)
            claim[slot[::-1]] = who[::-1]
            begin = np.concatenate([[0], np.cumsum(width[open_])[:-1]])
            won = np.logical_and.reduceat(free[slot] & (claim[slot] == who), begin)
            base[owner[open_[won]]] = at[won]
            free[slot[won[who]]] = False
            open_ = open_[~won]
        if len(open_):
            end = int(np.flatnonzero(~free)[-1]) + 1
            windows(open_)
    single = np.flatnonzero(width == 1)
    slots = ALPHABET + np.flatnonzero(free[ALPHABET:])  # so that no base is below 0
    if len(slots) < len(single):
        slots = np.concatenate([slots, len(free) + np.arange(len(single))])
    base[owner[single]] = slots[: len(single)] - label[first[single]]
    return base


def _edges(first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of each i, width[i] numbers, one after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(int(width.sum()))
