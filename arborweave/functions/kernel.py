"""Alignment of two sequence graphs (numpy).

A graph has sites 0 (start), 1..n (residues) and n+1 (stop); edges lead from
a smaller to a greater site and carry a weight. The best path through the
product of two graphs has states M (both move), X (left moves), Y (right
moves). Cells are filled by anti-diagonals: every predecessor of a cell lies
on an earlier one, whatever edges there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from arborweave.functions.models import Model, Scores

LOW = -1e30
M, X, Y = 0, 1, 2
#: What a site of a parent stems from. Fixed values.
TERMINAL, MATCHED, X_GAPPED, Y_GAPPED, X_SKIPPED, Y_SKIPPED = range(6)


@dataclass
class Limits:
    """When an alternative path that isn't used any more is given up, and what passing it by costs."""

    branches: int = 10
    distance: float = 0.5
    boundaries: int = 5
    weight: float = 0.9


READS = Limits(50_000, 5.0, 50_000, 1.0)


@dataclass
class Graph:
    """states of the residues 1..n, and edges as parallel arrays."""

    states: np.ndarray
    start: np.ndarray
    end: np.ndarray
    weight: np.ndarray
    skipped: np.ndarray
    distance: np.ndarray
    kind: np.ndarray
    left: np.ndarray
    right: np.ndarray
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    @property
    def n(self) -> int:
        return len(self.states)

    def layers(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Edges by rank among those into one site: (site, from, log weight, edge number) for the first, second, ..."""
        order = np.lexsort((np.arange(len(self.end)), self.end))
        end = self.end[order]
        first = np.searchsorted(end, end, "left")
        rank = np.arange(len(end)) - first
        out = []
        for k in range(int(rank.max(initial=-1)) + 1):
            e = order[rank == k]
            out.append((self.end[e], self.start[e], np.log(np.maximum(self.weight[e].astype(np.float64), 1e-30)), e))
        return out


def graph_of(states: np.ndarray, edges: list[tuple[int, int, float]] | None = None) -> Graph:
    """A graph of residues; without edges each site follows the one before."""
    n = len(states)
    if edges is None:
        start, end, weight = np.arange(n + 1), np.arange(1, n + 2), np.ones(n + 1)
    else:
        start, end, weight = (np.array(c) for c in zip(*edges, strict=True))
    zero = np.zeros(len(start))
    return Graph(states, start.astype(np.int64), end.astype(np.int64), weight.astype(np.float32), zero.astype(np.int32), zero.astype(np.float32), np.full(n, TERMINAL, np.int8), np.full(n, -1, np.int32), np.full(n, -1, np.int32), zero.astype(np.int32))


def homopolymer_edges(states: np.ndarray, weight: float = 0.9, least: int = 2) -> list[tuple[int, int, float]]:
    """Edges of a chain with one more around each part of a run of equal residues, so that a run may be read shorter."""
    n = len(states)
    edges = {(i, i + 1): 1.0 for i in range(n + 1)}
    i = 0
    while i < n:
        j = i
        while j + 1 < n and states[j + 1] == states[i]:
            j += 1
        if j - i + 1 >= least:  # sites i+1..j+1 are equal: one may be left out
            edges[(i, i + 2)] = weight
            edges[(i, i + 1)] = min(edges[(i, i + 1)], 1.0)
        i = j + 1
    return [(a, b, w) for (a, b), w in sorted(edges.items(), key=lambda x: (x[0][1], -x[0][0]))]


def quality_states(model: Model, text: str, quality: str, least: int = 10) -> np.ndarray:
    """States of a read; a base of a quality below `least` is unknown."""
    states = model.encode(text)
    if len(quality) == len(text):
        low = np.frombuffer(quality.encode("latin1", "replace"), np.uint8) < 33 + least
        states = states.copy()
        states[low] = model.unknown
    return states


def codon_graph(model: Model, dna: str) -> Graph:
    return graph_of(model.encode(dna))


@dataclass
class Path:
    """Steps (state, left site, right site, left edge, right edge) from start to stop, and the score."""

    steps: list[tuple[int, int, int, int, int]]
    left_stop: int
    right_stop: int
    score: float
    length: tuple[int, int]


def _band(low: list[int] | None, high: list[int] | None, n: int, m: int) -> np.ndarray | None:
    if low is None or high is None:
        return None
    j = np.arange(m + 1)
    return (j >= np.asarray(low)[:, None]) & (j <= np.asarray(high)[:, None])


def active(g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """(sites, edges) that lie on any way from start to stop; sites are numbers of residues."""
    order = np.argsort(g.end, kind="stable")
    ahead, back = np.zeros(g.n + 2, bool), np.zeros(g.n + 2, bool)
    ahead[0] = back[g.n + 1] = True
    start, end = g.start.tolist(), g.end.tolist()
    for e in order.tolist():
        if ahead[start[e]]:
            ahead[end[e]] = True
    for e in np.argsort(-g.start, kind="stable").tolist():
        if back[end[e]]:
            back[start[e]] = True
    live = ahead & back
    return np.flatnonzero(live[1:-1]) + 1, np.flatnonzero(live[g.start] & live[g.end])


def _compact(g: Graph) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph of the active sites, with the old number of each of its sites and edges."""
    sites, edges = active(g)
    place = np.zeros(g.n + 2, np.int64)
    place[sites], place[g.n + 1] = np.arange(1, len(sites) + 1), len(sites) + 1
    small = Graph(g.states[sites - 1], place[g.start[edges]], place[g.end[edges]], g.weight[edges], g.skipped[edges], g.distance[edges], g.kind[sites - 1], g.left[sites - 1], g.right[sites - 1], g.bounds[edges])
    return small, np.concatenate([[0], sites]), edges


def align(a: Graph, b: Graph, scores: Scores, low: list[int] | None = None, high: list[int] | None = None) -> Path:
    """The best path (see _fill), found among the sites that any edge still leads to."""
    x, sites_x, edges_x = _compact(a)
    y, sites_y, edges_y = _compact(b)
    if x.n < a.n or y.n < b.n:
        low = high = None
    p = _fill(x, y, scores, low, high)
    old = lambda numbers, i: int(numbers[i]) if i >= 0 else -1
    steps = [(s, old(sites_x, i), old(sites_y, j), old(edges_x, e), old(edges_y, f)) for s, i, j, e, f in p.steps]
    return Path(steps, int(edges_x[p.left_stop]), int(edges_y[p.right_stop]), p.score, (a.n, b.n))


def _fill(a: Graph, b: Graph, scores: Scores, low: list[int] | None = None, high: list[int] | None = None) -> Path:
    """The best path; ties keep the candidate that is looked at first.

    low, high: for each left site 0..n the lowest and highest right site that
    is filled; if no path lies inside, the whole matrix is filled.
    """
    n, m = a.n, b.n
    band = _band(low, high, n, m)
    s = scores.matrix(a.states, b.states) if n and m else np.zeros((n, m))
    width = m + 1
    v = np.full((3, (n + 1) * width), LOW)
    v[M, 0] = 0.0
    come = np.zeros((3, (n + 1) * width), np.int8)  # the state it came from
    by_a, by_b = np.full((3, (n + 1) * width), -1, np.int32), np.full((3, (n + 1) * width), -1, np.int32)
    la, lb = a.layers(), b.layers()
    # per site the edges of each layer, -1 where there is none
    ea, fa, wa = _table(la, n)
    eb, fb, wb = _table(lb, m)
    ea_, eb_ = np.array(ea), np.array(eb)
    ng, go, ge, close = scores.no_gap, scores.open, scores.extend, scores.close
    enter = np.array([2 * ng, close + ng, close + ng])[:, None]
    pairs = [(x, y) for x in range(len(ea)) for y in range(len(eb))]
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        if band is not None:
            inside = band[i, j]
            i, j = i[inside], j[inside]
        at = i * width + j
        # matches: the candidates of each pair of edges in turn, of which the first of the best is taken
        both = (i > 0) & (j > 0)
        p, q, here = (i, j, at) if both.all() else (i[both], j[both], at[both])
        if len(p):
            parts = []
            for x, y in pairs:
                c = v[:, fa[x][p] * width + fb[y][q]] + enter + (wa[x][p] + wb[y][q])
                if x or y:
                    c[:, (ea[x][p] < 0) | (eb[y][q] < 0)] = 2 * LOW
                parts.append(c)
            k, best = _first_best(parts)
            pair = k // 3
            v[M, here], come[M, here] = best + s[p - 1, q - 1], k % 3
            by_a[M, here], by_b[M, here] = ea_[pair // len(eb), p], eb_[pair % len(eb), q]
        # gaps: X moves in the left graph, Y in the right
        for state, order, moves, e_, f_, all_, edge, move_left in ((X, (X, Y, M), i > 0, ea, fa, ea_, by_a, True), (Y, (Y, X, M), j > 0, eb, fb, eb_, by_b, False)):
            p, q, here = (i, j, at) if moves.all() else (i[moves], j[moves], at[moves])
            if not len(p):
                continue
            site, still, last = (p, q, m) if move_left else (q, p, n)
            end = (still == 0) | (still == last)
            add = np.array([np.where(end, scores.end_extend, ge), np.full(len(p), close + go), ng + np.where(still == 0, scores.first_open, go)])
            parts = []
            for x in range(len(e_)):
                back = f_[x][site]
                c = v[:, back * width + q if move_left else p * width + back][list(order)] + add
                if x:
                    c[:, e_[x][site] < 0] = 2 * LOW
                parts.append(c)
            k, best = _first_best(parts)
            v[state, here], come[state, here], edge[state, here] = np.maximum(best, LOW), np.array(order, np.int8)[k % 3], all_[k // 3, site]
    # the end: every edge into the two stops
    top, where = LOW, None
    for x in np.flatnonzero(a.end == n + 1):
        for y in np.flatnonzero(b.end == m + 1):
            cell = int(a.start[x]) * width + int(b.start[y])
            w = float(np.log(max(float(a.weight[x]), 1e-30)) + np.log(max(float(b.weight[y]), 1e-30)))
            for state, add in ((M, ng + w), (X, close), (Y, close)):
                c = v[state, cell] + add
                if c > top:
                    top, where = c, (state, int(a.start[x]), int(b.start[y]), int(x), int(y))
    if where is None or top <= LOW / 2:
        if band is not None:
            return _fill(a, b, scores)
        raise ValueError("no path through the graphs")
    state, i, j, left_stop, right_stop = where
    steps = []
    while i or j:
        cell = i * width + j
        x, y = int(by_a[state, cell]), int(by_b[state, cell])
        steps.append((state, i if state != Y else -1, j if state != X else -1, x if state != Y else -1, y if state != X else -1))
        before = int(come[state, cell])
        if state != Y:
            i = int(a.start[x])
        if state != X:
            j = int(b.start[y])
        state = before
    return Path(steps[::-1], left_stop, right_stop, float(top), (n, m))


def _first_best(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the greatest of each column, of equal ones the first row."""
    c = parts[0] if len(parts) == 1 else np.concatenate(parts)
    k = c.argmax(axis=0)
    return k, c[k, np.arange(c.shape[1])]


def _table(layers: list, n: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    edges, fro, weight = [], [], []
    for site, start, logw, number in layers:
        e, f, w = np.full(n + 2, -1, np.int64), np.zeros(n + 2, np.int64), np.full(n + 2, LOW)
        e[site], f[site], w[site] = number, start, logw
        edges.append(e)
        fro.append(f)
        weight.append(w)
    return edges, fro, weight


def parent_of(a: Graph, b: Graph, path: Path, model: Model, branch_a: float, branch_b: float, limits: Limits | None = None) -> Graph:
    """The ancestor's graph: the sites along the path, sites that an edge passed by among them, and the children's edges between them."""
    limits = limits or Limits()
    sites: list[tuple[int, int, int]] = []  # (kind, left site, right site)
    i = j = 0

    def passed(until_a: int, until_b: int) -> None:
        nonlocal i, j
        sites.extend((X_SKIPPED, k, -1) for k in range(i + 1, until_a))
        sites.extend((Y_SKIPPED, -1, k) for k in range(j + 1, until_b))
        i, j = max(i, until_a - 1), max(j, until_b - 1)

    for state, x, y, _, _ in path.steps:
        passed(x if x > 0 else i + 1, y if y > 0 else j + 1)
        sites.append(({M: MATCHED, X: X_GAPPED, Y: Y_GAPPED}[state], x, y))
        i, j = max(i, x), max(j, y)
    passed(a.n + 1, b.n + 1)
    n = len(sites)
    kind = np.array([k for k, _, _ in sites], np.int8)
    left = np.array([x if x > 0 else -1 for _, x, _ in sites], np.int32)
    right = np.array([y if y > 0 else -1 for _, _, y in sites], np.int32)
    states = np.zeros(n, a.states.dtype if n else np.int64)
    for k in range(n):
        x, y = left[k], right[k]
        states[k] = model.parent_state(int(a.states[x - 1]), int(b.states[y - 1])) if x > 0 and y > 0 else a.states[x - 1] if x > 0 else b.states[y - 1]
    edges: dict[tuple[int, int], list[float]] = {}  # weight, branches and distance unused, boundaries
    for g, sides, used, length in (
        (a, left, {e for _, _, _, e, _ in path.steps if e >= 0} | {path.left_stop}, branch_a),
        (b, right, {e for _, _, _, _, e in path.steps if e >= 0} | {path.right_stop}, branch_b),
    ):
        place = np.full(g.n + 2, -1, np.int64)
        place[0], place[g.n + 1] = 0, n + 1
        mine = np.flatnonzero(sides > 0)
        place[sides[mine]] = mine + 1
        for e in range(len(g.start)):
            s, t = int(place[g.start[e]]), int(place[g.end[e]])
            if s < 0 or t < 0:
                continue
            on = e in used
            count, far = (0, 0.0) if on else (int(g.skipped[e]) + 1, float(g.distance[e]) + length)
            bounds = int(g.bounds[e]) + (1 if on and int(g.end[e]) - int(g.start[e]) > 1 else 0)
            if not on and (count > limits.branches or far > limits.distance):
                continue
            w = float(g.weight[e]) * (1.0 if on else limits.weight)
            old = edges.get((s, t))
            if old is None or (on and old[1] > 0) or w > old[0]:
                edges[(s, t)] = [w, count, far, bounds]
    # what was passed by too often goes: the edges inside the range
    for (s, t), (_, _, _, bounds) in list(edges.items()):
        if bounds > limits.boundaries:
            for key in [k for k in edges if s < k[1] <= t and k != (s, t) and (s <= k[0] < t)]:
                del edges[key]
    order = sorted(edges, key=lambda k: (k[1], edges[k][1], -k[0]))
    values = np.array([edges[k] for k in order]).reshape(-1, 4)
    start, end = (np.array([k[x] for k in order], np.int64) for x in (0, 1))
    return Graph(states, start, end, values[:, 0].astype(np.float32), values[:, 1].astype(np.int32), values[:, 2].astype(np.float32), kind, left, right, values[:, 3].astype(np.int32))


def path_of_rows(row_a: str, row_b: str, a: Graph, b: Graph) -> Path:
    """The path that two rows of a given alignment describe, without any search; columns with two gaps count nothing."""
    steps, i, j = [], 0, 0
    into_a = {(int(s), int(e)): k for k, (s, e) in enumerate(zip(a.start, a.end, strict=True))}
    into_b = {(int(s), int(e)): k for k, (s, e) in enumerate(zip(b.start, b.end, strict=True))}
    for p, q in zip(row_a, row_b, strict=True):
        x, y = p != "-", q != "-"
        if x and y:
            steps.append((M, i + 1, j + 1, into_a.get((i, i + 1), -1), into_b.get((j, j + 1), -1)))
        elif x:
            steps.append((X, i + 1, -1, into_a.get((i, i + 1), -1), -1))
        elif y:
            steps.append((Y, -1, j + 1, -1, into_b.get((j, j + 1), -1)))
        i, j = i + x, j + y
    return Path(steps, into_a.get((i, i + 1), -1), into_b.get((j, j + 1), -1), 0.0, (i, j))


def faults(g: Graph) -> list[str]:
    """What makes a graph invalid: an edge that doesn't go forwards, a site that no edge leads to or from on the way."""
    out = []
    if len(g.start) and ((g.start >= g.end).any() or (g.start < 0).any() or (g.end > g.n + 1).any()):
        out.append("direction")
    reach = {0}
    for s, t in sorted(zip(g.start.tolist(), g.end.tolist(), strict=True), key=lambda e: e[1]):
        if s in reach:
            reach.add(t)
    if g.n + 1 not in reach:
        out.append("unreachable")
    if len(set(zip(g.start.tolist(), g.end.tolist(), strict=True))) != len(g.start):
        out.append("repeated")
    return out


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def posterior(a: Graph, b: Graph, scores: Scores) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(forward total, backward total, posterior of each match cell, forward values) of two plain sequences, in logarithms but for the posterior.

    Sums use the plain opening and extension terms everywhere.
    """
    n, m = a.n, b.n
    s = scores.matrix(a.states, b.states) if n and m else np.zeros((n, m))
    ng, go, ge = scores.no_gap, scores.open, scores.extend
    move = np.array([[2 * ng, ng + go, ng + go], [ng, ge, go], [ng, go, ge]])  # from, to
    f = np.full((3, n + 1, m + 1), LOW)
    g = np.full((3, n + 1, m + 1), LOW)
    f[M, 0, 0] = 0.0
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        for state, di, dj in ((M, 1, 1), (X, 1, 0), (Y, 0, 1)):
            ok = (i >= di) & (j >= dj)
            p, q = i[ok], j[ok]
            if len(p):
                c = f[:, p - di, q - dj] + move[:, state][:, None]
                f[state, p, q] = np.maximum(LOW, _logsum(c) + (s[p - 1, q - 1] if state == M else 0.0))
    finish = np.array([ng, 0.0, 0.0])
    total = float(_logsum(f[:, n, m] + finish))
    g[:, n, m] = finish
    for d in range(n + m - 1, -1, -1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        for state in (M, X, Y):
            parts = []
            for to, di, dj in ((M, 1, 1), (X, 1, 0), (Y, 0, 1)):
                ok = (i + di <= n) & (j + dj <= m)
                p, q = np.minimum(i + di, n), np.minimum(j + dj, m)
                value = g[to, p, q] + move[state, to] + (s[np.minimum(i, n - 1), np.minimum(j, m - 1)] if to == M and n and m else 0.0)
                parts.append(np.where(ok, value, LOW))
            g[state, i, j] = np.maximum(LOW, _logsum(np.array(parts)))
    back = float(g[M, 0, 0])
    return total, back, np.exp(np.clip(f[M] + g[M] - total, -700, 0)), f


def sample(a: Graph, b: Graph, scores: Scores, seed: int) -> list[tuple[int, int, int]]:
    """A path (state, left site, right site) drawn by its probability; the same for the same seed."""
    rng = np.random.default_rng(seed)
    _, _, _, f = posterior(a, b, scores)
    ng, go, ge = scores.no_gap, scores.open, scores.extend
    move = np.array([[2 * ng, ng + go, ng + go], [ng, ge, go], [ng, go, ge]])
    i, j, out = a.n, b.n, []

    def draw(x: np.ndarray) -> int:
        p = np.exp(x - x.max())
        return int(rng.choice(3, p=p / p.sum()))

    state = draw(f[:, i, j] + np.array([ng, 0.0, 0.0]))
    while i or j:
        out.append((state, i if state != Y else -1, j if state != X else -1))
        di, dj = state != Y, state != X
        i, j = i - di, j - dj
        state = draw(f[:, i, j] + move[:, state]) if i or j else M
    return out[::-1]


def local(a: np.ndarray, b: np.ndarray, match: float = 5.0, mismatch: float = -4.0, opening: float = -12.0, extension: float = -4.0) -> tuple[float, int, int, int, int]:
    """(score, start, end, start, end) of the best local alignment of two arrays of residues with affine gaps; ends are exclusive, all 0 if nothing scores.

    Of equal scores the end that comes first by a and then by b is taken.
    """
    n, m = len(a), len(b)
    width = m + 1
    low = -1e18
    h, x, y = np.zeros((n + 1) * width), np.full((n + 1) * width, low), np.full((n + 1) * width, low)
    # where the alignment that ends in a cell begins
    sh = np.arange((n + 1) * width)
    sx, sy = sh.copy(), sh.copy()
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        at = i * width + j
        up, left, diag = at - width, at - 1, at - width - 1
        for gap, start, back in ((x, sx, up), (y, sy, left)):
            new, longer = h[back] + opening, gap[back] + extension
            gap[at] = np.maximum(new, longer)
            start[at] = np.where(new >= longer, sh[back], start[back])
        s = h[diag] + np.where((a[i - 1] & b[j - 1]) != 0, match, mismatch)
        c = np.array([np.zeros(len(i)), s, x[at], y[at]])
        k = c.argmax(axis=0)
        h[at] = c[k, np.arange(len(i))]
        sh[at] = np.choose(k, [at, np.where(h[diag] > 0, sh[diag], diag), sx[at], sy[at]])
    best = int(h.argmax())
    if h[best] <= 0:
        return 0.0, 0, 0, 0, 0
    begin = int(sh[best])
    return float(h[best]), begin // width, best // width, begin % width, best % width


#: Cells (times three states, a byte each) that align_many() keeps at once.
CELLS = 12_000_000


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]], scores: Scores) -> list[Path]:
    """align() of many pairs of plain sequences of states, several at a time; the same paths and scores.

    Pairs of like size are filled side by side, so each step of numpy works
    on an anti-diagonal of all of them.
    """
    out: list[Path | None] = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    group: list[int] = []
    n = m = 0
    for k in order:
        a, b = max(n, len(pairs[k][0])), max(m, len(pairs[k][1]))
        if group and (3 * (len(group) + 1) * (a + b + 1) * (a + 1) > CELLS or len(group) >= 64):
            _side_by_side(pairs, group, scores, out)
            group, a, b = [], len(pairs[k][0]), len(pairs[k][1])
        group.append(k)
        n, m = a, b
    if group:
        _side_by_side(pairs, group, scores, out)
    return out


def _side_by_side(pairs: list, group: list[int], scores: Scores, out: list) -> None:
    size = len(group)
    ns, ms = (np.array([len(pairs[k][x]) for k in group]) for x in (0, 1))
    n, m = int(ns.max()), int(ms.max())
    known = {int(s): x for x, s in enumerate(sorted({int(s) for k in group for t in pairs[k] for s in t}))}
    states = list(known)
    table = np.array([[scores.pair(x, y) for y in states] for x in states]).reshape(len(states), len(states))
    a, b = np.zeros((size, n), np.int64), np.zeros((size, m), np.int64)
    for r, k in enumerate(group):
        a[r, : ns[r]], b[r, : ms[r]] = ([known[int(s)] for s in t] for t in pairs[k])
    ng, go, ge, close = scores.no_gap, scores.open, scores.extend, scores.close
    enter = np.array([2 * ng, close + ng, close + ng])[:, None, None]
    come = np.zeros((3, size, n + m + 1, n + 1), np.int8)
    before = np.full((3, size, n + 1), LOW)  # the anti-diagonal before the last
    last = before.copy()
    last[M, :, 0] = 0.0
    total = np.full((3, size), LOW)
    done = np.flatnonzero(ns + ms == 0)
    total[:, done] = last[:, done, 0]
    for d in range(1, n + m + 1):
        now = np.full((3, size, n + 1), LOW)
        lo, hi = max(1, d - m), min(n, d - 1)
        if lo <= hi:
            c = before[:, :, lo - 1 : hi] + enter
            k = c.argmax(axis=0)
            s = table[a[:, lo - 1 : hi], b[:, d - hi - 1 : d - lo][:, ::-1]]
            now[M, :, lo : hi + 1] = np.take_along_axis(c, k[None], 0)[0] + s
            come[M, :, d, lo : hi + 1] = k
        for state, order, lo, hi, back in ((X, [X, Y, M], max(1, d - m), min(n, d), 1), (Y, [Y, X, M], max(0, d - m), min(n, d - 1), 0)):
            if lo > hi:
                continue
            i = np.arange(lo, hi + 1)
            still, end = (d - i, ms) if state == X else (i, ns)
            first = still == 0
            ends = first[None, :] | (still[None, :] == end[:, None])
            c = last[order][:, :, lo - back : hi + 1 - back]
            c[0] += np.where(ends, scores.end_extend, ge)
            c[1] += close + go
            c[2] += ng + np.where(first, scores.first_open, go)[None, :]
            k = c.argmax(axis=0)
            now[state, :, lo : hi + 1] = np.maximum(np.take_along_axis(c, k[None], 0)[0], LOW)
            come[state, :, d, lo : hi + 1] = np.array(order, np.int8)[k]
        before, last = last, now
        done = np.flatnonzero(ns + ms == d)
        total[:, done] = last[:, done, ns[done]]
    total += np.array([ng, close, close])[:, None]
    for r, k in enumerate(group):
        state, i, j, steps = int(total[:, r].argmax()), int(ns[r]), int(ms[r]), []
        score = float(total[state, r])
        mine = come[:, r]
        while i or j:
            frm = int(mine[state, i + j, i])
            steps.append((state, i if state != Y else -1, j if state != X else -1, i - 1 if state != Y else -1, j - 1 if state != X else -1))
            i, j, state = i - (state != Y), j - (state != X), frm
        out[k] = Path(steps[::-1], int(ns[r]), int(ms[r]), score, (int(ns[r]), int(ms[r])))
