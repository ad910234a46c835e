"""A run-compressed Burrows-Wheeler index over many short pieces, and matching statistics against it.

Pieces belong to classes; a match stays inside the pattern's class. Suffixes are sorted by class
first, so the index is one array of rows in which each class is a Burrows-Wheeler transform of its
own. Only its runs of equal symbols are kept: where a run starts, its symbol, where its first row maps
to, and the text positions of its first and last row. Matching statistics are streamed over the
patterns from right to left, one symbol of every pattern at a time: a row whose run has the pattern's
symbol follows the map; any other jumps to the nearer run with that symbol, above or below, whichever
shares the longer match, by its sampled end.
"""

from __future__ import annotations

import numpy as np

_PACK = 5  # symbols of 9 bits in one sort key, below 18 bits of the class
_CLASSES = 1 << 18


class RunIndex:
    def __init__(self, data: np.ndarray, at: np.ndarray, classes: np.ndarray):
        """``data``: bytes of all pieces, ``at``: where each begins (one more), ``classes``: 0, 1, ... ascending or not."""
        sizes = np.diff(at) + 1  # with an end symbol
        begin = np.concatenate([[0], np.cumsum(sizes)])
        n = int(begin[-1])
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[begin[1:] - 1] = False
        text[inside] = data.astype(np.int64) + 1
        owner = np.repeat(classes.astype(np.int64), sizes)
        self.n = n
        self._sort(text, int(sizes.max(initial=0)), owner, np.repeat(np.arange(len(classes)), sizes), begin[1:] - 1)
        before = np.empty(n, np.int64)
        before[1:] = text[:-1]
        before[begin[:-1]] = 0  # the end symbol stands before each piece
        own = owner[self.rows]
        symbol = own * 257 + before[self.rows]
        edge = np.ones(n, bool)
        edge[1:] = symbol[1:] != symbol[:-1]
        maps = np.empty(n, np.int64)
        maps[np.argsort(symbol, kind="stable")] = np.arange(n)
        self.start = np.flatnonzero(edge)
        self.last = np.append(self.start[1:], n) - 1
        self.symbol, self.map = symbol[self.start], maps[self.start]
        self.first_at, self.last_at = self.rows[self.start], self.rows[self.last]
        self.by_symbol = np.argsort(self.symbol, kind="stable")
        self.ordered = self.symbol[self.by_symbol] * len(self.start) + self.by_symbol
        kinds = np.unique(own)
        self.class_row = np.full(int(classes.max(initial=0)) + 1, -1, np.int64)
        self.class_row[kinds] = np.searchsorted(own, kinds)
        del self.rows  # the samples at the runs' ends are all that is kept

    def _sort(self, text: np.ndarray, longest: int, owner: np.ndarray, piece: np.ndarray, ends: np.ndarray) -> None:
        """Ranks by ever longer starts, each twice the last; only rows that are still tied are sorted again.

        A rank is the sorted place of the first row with that start. Suffixes that are equal to their
        pieces' ends are in the order of the pieces.
        """
        n = len(text)
        if int(owner[-1] if n else 0) >= _CLASSES or (n and int(owner.max()) >= _CLASSES):
            raise ValueError("too many classes for one index")
        packed = np.zeros(n, np.int64)
        for j in range(_PACK):
            packed <<= 9
            packed[: n - j] |= text[j:]
        for k in range(1, _PACK):  # nothing of what follows a piece's end
            rows = ends[ends + 1 >= k] - k + 1
            rows = rows[piece[rows] == piece[ends[ends + 1 >= k]]]
            packed[rows] &= -1 << (9 * (_PACK - k))
        self.packed = np.append(packed, 0)
        keys = owner << (9 * _PACK) | packed
        order = np.argsort(keys)
        keys = keys[order]
        edge = np.ones(n, bool)
        edge[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(edge)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, np.diff(np.append(first, n))) + 1
        alone = edge.copy()
        alone[:-1] &= edge[1:]
        tied = order[~alone]
        self.levels, size = [], _PACK
        while True:
            self.levels.append((size, np.append(rank, 0).astype(np.int32)))
            if size >= longest or not len(tied):
                break
            old = rank[tied]
            on = tied + size
            more = on <= ends[piece[tied]]
            keys = old * (n + 1) + np.where(more, rank[np.minimum(on, n - 1)], piece[tied] + 1)
            order = np.argsort(keys)
            tied, keys, old = tied[order], keys[order], old[order]
            edge, start = np.ones(len(tied), bool), np.ones(len(tied), bool)
            edge[1:], start[1:] = keys[1:] != keys[:-1], old[1:] != old[:-1]
            place = np.arange(len(tied))
            rank[tied] = old + np.maximum.accumulate(np.where(edge, place, 0)) - np.maximum.accumulate(np.where(start, place, 0))
            alone = edge.copy()
            alone[:-1] &= edge[1:]
            tied = tied[~alone]
            size *= 2
        self.rows = np.argsort(rank, kind="stable")

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common start of the suffixes at ``a`` and ``b``, up to ``most``."""
        done = np.zeros(len(a), np.int64)
        for size, rank in reversed(self.levels):
            x, y = np.minimum(a + done, self.n), np.minimum(b + done, self.n)
            same = (rank[x] == rank[y]) & (x < self.n) & (y < self.n)
            done[same] += size
        x = self.packed[np.minimum(a + done, self.n)] ^ self.packed[np.minimum(b + done, self.n)]
        rest = np.full(len(a), _PACK)
        for j in range(_PACK - 1, -1, -1):
            rest[(x >> (9 * (_PACK - 1 - j))) != 0] = j
        return np.minimum(done + rest, most)

    def statistics(self, data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """For each byte of the patterns, the longest match that starts there with a piece of its class."""
        out = np.zeros(len(data), np.int64)
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        order = order[self.class_row[classes[order]] >= 0] if len(self.class_row) else order[:0]
        ends, kinds, sizes = at[1:][order], classes[order].astype(np.int64), sizes[order]
        home = self.class_row[kinds]
        row = home.copy()
        run = np.searchsorted(self.start, row, "right") - 1
        place, length = self.first_at[run], np.zeros(len(order), np.int64)
        runs = len(self.start)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -step, "left"))  # patterns longer than this step
            want = kinds[:k] * 257 + data[ends[:k] - 1 - step].astype(np.int64) + 1
            run = np.searchsorted(self.start, row[:k], "right") - 1
            jump = np.flatnonzero(self.symbol[run] != want)
            if len(jump):
                w, r = want[jump], run[jump]
                pos = np.searchsorted(self.ordered, w * runs + r)
                up, down = self.by_symbol[np.maximum(pos - 1, 0)], self.by_symbol[np.minimum(pos, runs - 1)]
                has_up, has_down = (pos > 0) & (self.symbol[up] == w), (pos < runs) & (self.symbol[down] == w)
                a, most = place[jump], length[jump]
                with_up = np.where(has_up, self.shared(a, self.last_at[up], most), -1)
                with_down = np.where(has_down, self.shared(a, self.first_at[down], most), -1)
                upper = with_up >= with_down
                to = np.where(upper, up, down)
                none = ~(has_up | has_down)
                length[jump] = np.where(none, -1, np.maximum(with_up, with_down))
                row[jump] = np.where(upper, self.last[to], self.start[to])
                place[jump] = np.where(upper, self.last_at[to], self.first_at[to])
                run[jump] = to
                lost = jump[none]
            else:
                lost = jump
            row[:k] = self.map[run] + row[:k] - self.start[run]
            place[:k] -= 1
            length[:k] += 1
            if len(lost):
                row[lost] = home[lost]
                place[lost] = self.first_at[np.searchsorted(self.start, home[lost], "right") - 1]
            out[ends[:k] - 1 - step] = length[:k]
        return out
