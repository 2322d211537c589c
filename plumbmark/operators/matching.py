"""Greedy matching of a drawing's lines, from the lines themselves: pairs are made where they are looked for, and none is kept or sent.

The pairs of a dense drawing grow with the square of its lines, what is held here grows with the lines. Angles and lengths come from
Spark, so that a pair passes here exactly if it passes in the joins of `spatial`; the rest is plain arithmetic in the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plumbmark.params import Params

ENDS = ("x1", "y1", "x2", "y2")
#: Pairs or walls that are looked at in one go at first; each further go has as many again as all before.
FIRST = 256


class Lines:
    """Columns of lines (idx, x1 .. y2, angle, size, bin), sorted, with the lines near each bin of directions."""

    def __init__(self, t: pa.Table, bins: int, order):
        cols = {c: t[c].to_numpy() for c in ("idx", *ENDS, "angle", "size", "bin")}
        at = order(cols)
        self.idx, self.x1, self.y1, self.x2, self.y2, self.angle, self.size, self.bin = (c[at] for c in cols.values())
        self.dx, self.dy = self.x2 - self.x1, self.y2 - self.y1
        self.mx, self.my = (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2
        self.bins = bins
        # rows that share a number are one line
        self.same = np.unique(self.idx, return_inverse=True)[1]
        self.used = np.zeros(len(at), bool)
        self.gone = np.zeros(bins, np.int64)

    def around(self, b: int) -> list[int]:
        return sorted({(b + k) % self.bins for k in (-1, 0, 1)})

    def free(self, at: np.ndarray) -> np.ndarray:
        return ~self.used[self.same[at]]

    def take(self, near: dict[int, np.ndarray], *rows: int) -> list[int]:
        """Marks rows as used; returns the bins of whose lines the half is used."""
        out = []
        for row in rows:
            self.used[self.same[row]] = True
            for b in self.around(int(self.bin[row])):
                self.gone[b] += 1
                if b in near and 2 * self.gone[b] > len(near[b]):
                    out.append(b)
        return out

    def turn(self, a: int, at: np.ndarray) -> np.ndarray:
        gap = np.abs(self.angle[a] - self.angle[at])
        return np.minimum(gap, 180.0 - gap)

    def near(self) -> dict[int, np.ndarray]:
        """Of each bin that has lines, the lines of it and of the bins beside it."""
        of = {int(b): np.flatnonzero(self.bin == b) for b in np.unique(self.bin)}
        return {b: np.sort(np.concatenate([of[x] for x in self.around(b) if x in of])) for b in of}


def _overlap(s: Lines, a: int, b: np.ndarray) -> np.ndarray:
    """`geometry.overlap` of line a with lines b."""

    def shared(x1, y1, dx, dy, size, t) -> np.ndarray:
        at = [((x - x1) * dx + (y - y1) * dy) / size for x, y in ((s.x1[t], s.y1[t]), (s.x2[t], s.y2[t]))]
        return np.minimum(np.maximum(*at), size) - np.maximum(np.minimum(*at), 0.0)

    of_a = shared(s.x1[a], s.y1[a], s.dx[a], s.dy[a], s.size[a], b) / s.size[b]
    of_b = shared(s.x1[b], s.y1[b], s.dx[b], s.dy[b], s.size[b], a) / s.size[a]
    return np.maximum(np.where(s.size[b] > s.size[a], of_b, of_a), 0.0)


def walls(t: pa.Table, p: Params) -> pa.Table:
    """Greedy: longest line first (ties: the smaller number), with its free partner of least gap (ties: the longer, then the smaller number).

    A partner's middle lies at most the widest gap from the line, so across the middle direction of the line's bin at most that and what the
    line's own turn makes of half their lengths: lines near a bin are sorted across its middle direction, and only that strip is looked at.
    """
    s = Lines(t, int(180 // p.angle), lambda c: np.lexsort((c["idx"], -c["size"])))
    near, across, longest = s.near(), {}, {}
    for b in near:
        way = np.radians((b + 0.5) * p.angle)
        place = s.my[near[b]] * np.cos(way) - s.mx[near[b]] * np.sin(way)
        order = np.argsort(place, kind="stable")
        near[b], across[b], longest[b] = near[b][order], place[order], s.size[near[b]].max()
    found = []
    for a in range(len(s.idx)):
        if s.used[s.same[a]]:
            continue
        b = int(s.bin[a])
        way = (b + 0.5) * p.angle
        turned = abs(s.angle[a] - way)
        reach = ((s.size[a] + longest[b]) / 2 + p.wall_gap[1] * np.sin(np.radians(p.angle))) / np.cos(np.radians(p.angle))
        reach = p.wall_gap[1] + reach * np.sin(np.radians(turned)) * 1.01 + 1
        place = s.my[a] * np.cos(np.radians(way)) - s.mx[a] * np.sin(np.radians(way))
        c = near[b][np.searchsorted(across[b], place - reach) : np.searchsorted(across[b], place + reach, side="right")]
        c = c[s.free(c) & (s.idx[c] != s.idx[a])]
        c = c[s.turn(a, c) <= p.angle]
        gap = np.abs(s.dy[a] * s.mx[c] - s.dx[a] * s.my[c] + s.x2[a] * s.y1[a] - s.y2[a] * s.x1[a]) / s.size[a]
        fits = (gap >= p.wall_gap[0]) & (gap <= p.wall_gap[1])
        c, gap = c[fits], gap[fits]
        fits = _overlap(s, a, c) >= p.wall_overlap
        c, gap = c[fits], gap[fits]
        if not len(c):
            continue
        # rows go by length and number already
        best = np.lexsort((c, gap))[0]
        found.append((a, c[best], gap[best]))
        for b in s.take(near, a, c[best]):
            left = s.free(near[b])
            near[b], across[b], s.gone[b] = near[b][left], across[b][left], 0
    a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
    out = {"wall_idx": np.arange(len(a), dtype=np.int32), **{c: getattr(s, c)[a] for c in ENDS}, "thickness": np.array([f[2] for f in found], float), "line_a": s.idx[a], "line_b": s.idx[b]}
    turn = np.abs(s.angle[a] - s.angle[b])
    return _table(t, out | {"angle_gap": np.minimum(turn, 180.0 - turn)})


class Walls:
    """A drawing's walls by cells, to tell whether a point is beside one."""

    def __init__(self, t: pa.Table, slack: float):
        self.x1, self.y1, x2, y2, thick = (t[c].to_numpy() for c in (*ENDS, "thickness"))
        self.dx, self.dy, self.slack = x2 - self.x1, y2 - self.y1, slack + thick
        self.side, n = 64.0, len(thick)
        wide, high = np.abs(self.dx) + 2 * self.slack + 2, np.abs(self.dy) + 2 * self.slack + 2
        while ((wide / self.side + 2) * (high / self.side + 2)).sum() > 64 * n:
            self.side *= 2
        first, last = ([np.floor((f(p, q) + k * (self.slack + 1)) / self.side).astype(np.int64) for p, q in ((self.x1, x2), (self.y1, y2))] for f, k in ((np.minimum, -1), (np.maximum, 1)))
        rows, cols = last[0] - first[0] + 1, last[1] - first[1] + 1
        self.wall = np.repeat(np.arange(n), rows * cols)
        nth = np.arange(len(self.wall)) - np.repeat(np.cumsum(rows * cols) - rows * cols, rows * cols)
        cell = self.key(first[0][self.wall] + nth // cols[self.wall], first[1][self.wall] + nth % cols[self.wall])
        order = np.argsort(cell, kind="stable")
        self.wall, self.cell = self.wall[order], cell[order]

    @staticmethod
    def key(x, y):
        """Cells may share a key, which only adds walls to look at."""
        return x * 1_000_003 + y

    def beside(self, x: float, y: float) -> bool:
        key = self.key(int(np.floor(x / self.side)), int(np.floor(y / self.side)))
        i, end, step = int(np.searchsorted(self.cell, key)), int(np.searchsorted(self.cell, key, side="right")), FIRST
        while i < end:
            w = self.wall[i : min(i + step, end)]
            dx, dy = self.dx[w], self.dy[w]
            t = np.maximum(0.0, np.minimum(1.0, ((x - self.x1[w]) * dx + (y - self.y1[w]) * dy) / (dx * dx + dy * dy)))
            ex, ey = self.x1[w] + t * dx - x, self.y1[w] + t * dy - y
            if (np.sqrt(ex * ex + ey * ey) < self.slack[w]).any():
                return True
            i, step = i + step, 2 * step
        return False


def windows(t: pa.Table, wall: pa.Table, p: Params) -> pa.Table:
    """Pairs in the order of their numbers: those on a wall are accepted, each line in one at most; those met off any wall are refused, and stay free."""
    s, on = Lines(t, int(180 // p.angle), lambda c: np.argsort(c["idx"], kind="stable")), Walls(wall, p.window_slack)
    near, found = s.near(), []
    for a in range(len(s.idx)):
        if s.used[s.same[a]] or not s.size[a] > 0:
            continue
        of = near[int(s.bin[a])]
        i, step, done = int(np.searchsorted(of, a, side="right")), FIRST, False
        while i < len(of) and not done:
            c = of[i : i + step]
            c = c[s.free(c) & (s.idx[c] != s.idx[a])]
            c = c[s.turn(a, c) <= p.angle]
            gap = np.abs((s.my[c] - s.my[a]) * s.dx[a] - (s.mx[c] - s.mx[a]) * s.dy[a]) / s.size[a]
            fits = (gap >= p.window_gap[0]) & (gap <= p.window_gap[1])
            for b, width in zip(c[fits].tolist(), gap[fits].tolist(), strict=True):
                done = on.beside((s.mx[a] + s.mx[b]) / 2, (s.my[a] + s.my[b]) / 2)
                found.append((a, b, width, done))
                if done:
                    for k in s.take(near, a, b):
                        near[k], s.gone[k] = near[k][s.free(near[k])], 0
                    break
            i, step = i + step, 2 * step
    a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
    ends = {f"{c}_{k}": getattr(s, c)[v] for k, v in (("i", a), ("j", b)) for c in ENDS}
    return _table(t, {"seg_i": s.idx[a], "seg_j": s.idx[b], "gap": np.array([f[2] for f in found], float), "accepted": np.array([f[3] for f in found], bool), **ends})


def _table(t: pa.Table, columns: dict[str, np.ndarray]) -> pa.Table:
    """The columns behind the drawing's id."""
    n = len(next(iter(columns.values())))
    ids = t["drawing_id"].combine_chunks().take(pa.array(np.zeros(n, np.int64))) if n else t["drawing_id"].combine_chunks().slice(0, 0)
    return pa.table({"drawing_id": ids, **{c: pa.array(v) for c, v in columns.items()}})
