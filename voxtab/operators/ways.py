"""Shortest ways inside one task: the graphs of many cases as one table of arcs, sources spread from changed vertices only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: States (a source's group times a vertex) that are held at a time.
HELD = 250_000


def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """One number for every value of columns that belong together, the same in all; nulls are one value."""
    both = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks()
    found = pc.fill_null(pc.dictionary_encode(both).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return np.split(found, np.cumsum([len(x) for x in columns])[:-1])


def paired(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """One number for every pair of a value of a and one of b."""
    whole = np.concatenate(a) * (max((x.max(initial=0) for x in b), default=0) + 1) + np.concatenate(b)
    found = np.unique(whole, return_inverse=True)[1].reshape(-1)
    return np.split(found, np.cumsum([len(x) for x in a])[:-1])


class Graphs:
    """The arcs (on, u, v, w) and the points (on, by, u, ...) of some groups, with numbers for groups, vertices and sources' groups.

    Vertices are ordered by their group, arcs by their first vertex. A source's group
    has a state for every vertex of its group, in the same order.
    """

    def __init__(self, arcs: pa.Table, points: pa.Table, on: list[str], by: list[str]):
        group = codes(arcs.column(on[0]), points.column(on[0]))
        for c in on[1:]:
            group = paired(group, codes(arcs.column(c), points.column(c)))
        u, v, p = codes(arcs.column("u"), arcs.column("v"), points.column("u"))
        u, v, p = paired([group[0], group[0], group[1]], [u, v, p])
        of = np.zeros(max((x.max(initial=-1) for x in (u, v, p)), default=-1) + 1, np.int64)
        of[u], of[v], of[p] = group[0], group[0], group[1]  # numbers of pairs are ordered by group
        order = np.argsort(u, kind="stable")
        self.to, self.w = v[order], arcs.column("w").to_numpy()[order]
        self.arcs_of = np.searchsorted(u[order], np.arange(len(of) + 1))
        self.row = np.zeros(len(of), np.int64)  # where a vertex stands in arcs' v or, behind these, in points' u
        self.row[p] = len(v) + np.arange(len(p))
        self.row[v] = np.arange(len(v))
        self.names = pa.chunked_array([c for x in (arcs.column("v"), points.column("u")) for c in x.chunks], points.schema.field("u").type)
        key = group[1]
        for c in by:
            key = paired([key], codes(points.column(c)))[0]
        self.point, self.key, self.vertices = p, key, np.searchsorted(of, np.arange(of.max(initial=-1) + 2))
        self.group = group[1]

    def parts(self, used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of the used points with not too many states: the points, the state of each, the first state of each source's group, and for every state what it lies behind its vertex."""
        at = np.flatnonzero(used)
        at = at[np.argsort(self.key[at], kind="stable")]
        if not len(at):
            return
        start = np.flatnonzero(np.r_[True, self.key[at][1:] != self.key[at][:-1]])
        group = self.group[at[start]]
        size = self.vertices[group + 1] - self.vertices[group]
        cut = np.flatnonzero(np.diff(np.cumsum(size) // HELD, prepend=-1))
        for lo, hi in zip(cut, [*cut[1:], len(start)]):
            base = np.concatenate([[0], np.cumsum(size[lo:hi])])[:-1]
            behind = np.repeat(base - self.vertices[group[lo:hi]], size[lo:hi])
            mine = at[start[lo] : start[hi] if hi < len(start) else len(at)]
            no = np.repeat(np.arange(hi - lo), np.diff(np.r_[start[lo:hi], start[lo] + len(mine)]))
            yield mine, self.point[mine] + (base - self.vertices[group[lo:hi]])[no], base, behind

    def step(self, states: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs from states: which of them, the state that an arc leads to, its length."""
        vertex = states - behind[states]
        n = self.arcs_of[vertex + 1] - self.arcs_of[vertex]
        of = np.repeat(np.arange(len(states)), n)
        arc = np.arange(len(of)) + np.repeat(self.arcs_of[vertex] - np.concatenate([[0], np.cumsum(n)])[:-1], n)
        return of, self.to[arc] + behind[states][of], self.w[arc]

    def named(self, vertices: np.ndarray) -> pa.ChunkedArray:
        return self.names.take(pa.array(self.row[vertices]))


def _owner(states: np.ndarray, mine: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A point of the same source's group for each state."""
    of = np.zeros(len(base), np.int64)
    of[np.searchsorted(base, at, "right") - 1] = mine
    return of[np.searchsorted(base, states, "right") - 1]


def _split(points: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    kind = points.column("_end").to_numpy(zero_copy_only=False).astype(bool)
    return ~kind, kind


def least_ways(arcs: pa.Table, points: pa.Table, on: list[str], by: list[str], limit: float | None, all_ends: bool) -> pa.Table:
    """(on, by, u, dist): the least way from the nearest point of the same `by` that is no end, as far as ways of at most `limit` reach; of ends' vertices alone unless all_ends."""
    g = Graphs(arcs, points, on, by)
    source, end = _split(points)
    wanted = np.full(len(g.row), all_ends)
    wanted[g.point[end]] = True
    out = []
    for mine, at, base, behind in g.parts(source):
        dist = np.full(len(behind), np.inf)
        dist[at] = 0.0
        front = np.unique(at)
        while len(front):
            of, to, w = g.step(front, behind)
            now = dist[front][of] + w
            better = now < dist[to] - 1e-12
            if limit is not None:
                better &= now <= limit + 1e-9
            to, now = to[better], now[better]
            np.minimum.at(dist, to, now)
            front = np.unique(to)
        found = np.flatnonzero(np.isfinite(dist))
        found = found[wanted[found - behind[found]]]
        row = points.take(pa.array(_owner(found, mine, at, base)))
        out.append(pa.table([*[row.column(c) for c in (*on, *by)], g.named(found - behind[found]), pa.array(dist[found])], names=[*on, *by, "u", "dist"]))
    return pa.concat_tables(out) if out else pa.table([*[points.column(c).slice(0, 0) for c in (*on, *by, "u")], pa.array([], pa.float64())], names=[*on, *by, "u", "dist"])


def two_least_ways(arcs: pa.Table, points: pa.Table, on: list[str], by: list[str], all_ends: bool) -> pa.Table:
    """(on, by, u, rank, src, dist): for every vertex its nearest point and the nearest one of another src of the same `by`; equal lengths (to nine decimals) go to the smaller src."""
    g = Graphs(arcs, points, on, by)
    source, end = _split(points)
    wanted = np.full(len(g.row), all_ends)
    wanted[g.point[end]] = True
    names = points.column("src").combine_chunks()
    value = names.fill_null(0).to_numpy(zero_copy_only=False)
    no = np.unique(value, return_inverse=True)[1].reshape(-1)

    def two(state: np.ndarray, src: np.ndarray, dist: np.ndarray, point: np.ndarray):
        """Of every state the nearest and the next of another src, in this order."""
        for key in (np.lexsort((dist, src, state)), None):
            if key is None:
                key = np.lexsort((src, np.round(dist, 9), state))
                state, src, dist, point = state[key], src[key], dist[key], point[key]
                start = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
                rank = np.arange(len(state)) - np.repeat(start, np.diff(np.r_[start, len(state)]))
                keep = rank < 2
                return state[keep], src[keep], dist[keep], point[keep], rank[keep]
            state, src, dist, point = state[key], src[key], dist[key], point[key]
            first = np.r_[True, (state[1:] != state[:-1]) | (src[1:] != src[:-1])]
            state, src, dist, point = state[first], src[first], dist[first], point[first]

    out = []
    for mine, at, _, behind in g.parts(source):
        n = len(behind)
        held = [np.full((2, n), -1), np.full((2, n), np.inf), np.full((2, n), -1)]  # src, dist and the point, by rank

        def take(state, src, dist, point):
            """Puts candidates into the states; the labels that are new or shorter."""
            hit = np.unique(state)
            old = [(hit, *[x[r][hit] for x in held]) for r in (0, 1)]
            old = [tuple(c[o[1] >= 0] for c in o) for o in old]
            cat = [np.concatenate(x) for x in zip((state, src, dist, point), *old)]
            s, c, d, p, rank = two(*cat)
            was = np.where(held[0][0][s] == c, held[1][0][s], np.where(held[0][1][s] == c, held[1][1][s], np.inf))
            new = np.isinf(was) | (d < was - 1e-9)
            for x, y in zip(held, (c, d, p)):
                x[rank, s] = y
            return s[new], c[new], d[new], p[new]

        state, src, dist, point = take(at, no[mine], np.zeros(len(at)), mine)
        while len(state):
            of, to, w = g.step(state, behind)
            state, src, dist, point = take(to, src[of], dist[of] + w, point[of]) if len(to) else (to,) * 4
        for r in (0, 1):
            found = np.flatnonzero(held[0][r] >= 0)
            found = found[wanted[found - behind[found]]]
            row = points.take(pa.array(held[2][r][found]))
            out.append(pa.table([*[row.column(c) for c in (*on, *by)], g.named(found - behind[found]), pa.array(np.full(len(found), r + 1, np.int32)), row.column("src"), pa.array(held[1][r][found])], names=[*on, *by, "u", "rank", "src", "dist"]))
    empty = pa.table([*[points.column(c).slice(0, 0) for c in (*on, *by, "u")], pa.array([], pa.int32()), points.column("src").slice(0, 0), pa.array([], pa.float64())], names=[*on, *by, "u", "rank", "src", "dist"])
    return pa.concat_tables(out) if out else empty
