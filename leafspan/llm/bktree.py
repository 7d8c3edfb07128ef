"""A BK-tree searched for many values at once: distances of a whole frontier are worked out together with bit-parallel
dynamic programming on numpy words."""

from __future__ import annotations

import numpy as np

#: Longest entry or value that fits the bit vectors; longer ones are compared one by one.
WORD = 64


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Strings:
    """Strings as a padded matrix of code points."""

    def __init__(self, values: list[str]):
        self.values = values
        self.length = np.array([len(v) for v in values], np.int64)
        self.code = np.zeros((len(values), max(1, int(self.length.max(initial=0)))), np.int32)
        for i, v in enumerate(values):
            self.code[i, : len(v)] = np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.int32)


class Patterns(Strings):
    """Strings with, for each sign of their alphabet, the bit vector of its places; sign 0 stands for all others."""

    def __init__(self, values: list[str]):
        super().__init__(values)
        inside = np.arange(self.code.shape[1])[None, :] < self.length[:, None]
        self.alphabet = np.unique(self.code[inside])
        self.bits = np.zeros((len(values), len(self.alphabet) + 1), np.uint64)
        sign = np.searchsorted(self.alphabet, self.code) + 1
        for j in range(min(WORD, self.code.shape[1])):
            row = np.flatnonzero(inside[:, j])
            self.bits[row, sign[row, j]] |= np.uint64(1) << np.uint64(j)

    def signs(self, code: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros_like(code)
        at = np.minimum(np.searchsorted(self.alphabet, code), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == code, at + 1, 0)


def distances(a: Patterns, ia: np.ndarray, b: Strings, ib: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """Levenshtein distances of the pairs a[ia], b[ib]."""
    out = np.empty(len(ia), np.int64)
    signs = a.signs(b.code)
    for s in range(0, len(ia), chunk):
        out[s : s + chunk] = _distances(a, ia[s : s + chunk], b, signs, ib[s : s + chunk])
    return out


def _distances(a: Patterns, ia: np.ndarray, b: Strings, signs: np.ndarray, ib: np.ndarray) -> np.ndarray:
    la, lb = a.length[ia], b.length[ib]
    one = np.uint64(1)
    pv = np.full(len(ia), ~np.uint64(0))
    mv = np.zeros(len(ia), np.uint64)
    top = one << np.clip(la - 1, 0, WORD - 1).astype(np.uint64)
    score = la.copy()
    for j in range(int(lb.max(initial=0))):
        eq = a.bits[ia, signs[ib, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += (j < lb) * (((ph & top) != 0).astype(np.int64) - ((mh & top) != 0))
        ph = (ph << one) | one
        mh = mh << one
        pv = mh | ~(xv | ph)
        mv = ph & xv
    score = np.where(la == 0, lb, score)
    for i in np.flatnonzero(la > WORD):
        score[i] = levenshtein(a.values[ia[i]], b.values[ib[i]])
    return score


class BKTree:
    """Distinct strings; every child of a node stands at its own distance from it."""

    def __init__(self, values: list[str]):
        self.entries = Patterns(list(dict.fromkeys(values)))
        n = len(self.entries.values)
        self.children: list[dict[int, int]] = [{} for _ in range(n)]
        todo = np.arange(1, n)
        at = np.zeros(len(todo), np.int64)
        while len(todo):  # all entries still on their way go down one level together
            d = distances(self.entries, at, self.entries, todo)
            down, node = [], []
            for k, i, x in zip(d.tolist(), todo.tolist(), at.tolist()):
                child = self.children[x].setdefault(k, i)
                if child != i:
                    down.append(i)
                    node.append(child)
            todo, at = np.array(down, np.int64), np.array(node, np.int64)
        self.first = np.zeros(n + 1, np.int64)
        self.first[1:] = np.cumsum([len(c) for c in self.children])
        self.child = np.array([x for c in self.children for x in c.values()], np.int64)
        self.edge = np.array([k for c in self.children for k in c], np.int64)

    def search(self, values: list[str], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value index, entry index, distance) of every entry within each value's limit."""
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not self.entries.values or not values:
            return (np.zeros(0, np.int64),) * 3
        asked = Strings(values)
        q, node = np.arange(len(values)), np.zeros(len(values), np.int64)
        while len(q):
            d = distances(self.entries, node, asked, q)
            near = d <= limit[q]
            hits.append((q[near], node[near], d[near]))
            # triangle inequality: an entry within the limit hangs on an edge between d - limit and d + limit
            count = self.first[node + 1] - self.first[node]
            rep = np.repeat(np.arange(len(q)), count)
            edge = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + self.first[node[rep]]
            keep = np.abs(self.edge[edge] - d[rep]) <= limit[q[rep]]
            q, node = q[rep[keep]], self.child[edge[keep]]
        return tuple(np.concatenate(x) for x in zip(*hits))
