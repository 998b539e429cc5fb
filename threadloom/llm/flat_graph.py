"""A robust-pruned flat graph of a shard's vectors: built in growing batches, searched greedily from its medoid.

All searches of a shard advance together, one expansion a step, so that the work is a few array operations a step."""

from __future__ import annotations

import numpy as np

#: Neighbours kept by the pruning, and with those that point back; candidates that a search holds; slack of the pruning.
DEGREE, MOST_DEGREE, BEAM, ALPHA = 16, 32, 32, 1.2
#: Pairs whose likenesses are computed at once.
CHUNK = 1 << 16


def likeness(units: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosines of rows a and b of unit vectors, pair by pair."""
    out = np.empty(len(a), units.dtype)
    for at in range(0, len(a), CHUNK):
        out[at : at + CHUNK] = np.einsum("pd,pd->p", units[a[at : at + CHUNK]], units[b[at : at + CHUNK]])
    return out


def medoid(units: np.ndarray) -> int:
    """The vector nearest to the mean."""
    return int(np.argmax(units @ units.mean(axis=0)))


def search(units: np.ndarray, adjacent: np.ndarray, start: int, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search from `start` for the vectors nearest to each of `queries` (places): (places, likenesses, seen).

    Each step expands each query's best candidate that is not expanded yet, until its `beam` best all are. `adjacent`
    has a row of places a vector, -1 where there are fewer. places, likenesses: best first, -1 where there are fewer.
    seen: whether a query was compared with a vector."""
    rows = np.arange(len(queries))
    seen = np.zeros((len(queries), len(units)), bool)
    seen[:, start] = True
    held = np.full((len(queries), beam), -1, np.int32)
    near = np.full((len(queries), beam), -2, units.dtype)
    done = np.ones((len(queries), beam), bool)
    held[:, 0], near[:, 0], done[:, 0] = start, units[queries] @ units[start], False
    while True:
        waiting = ~done
        active = rows[waiting.any(axis=1)]
        if not len(active):
            return held, near, seen
        best = waiting[active].argmax(axis=1)  # candidates are in order
        done[active, best] = True
        ahead = adjacent[held[active, best]]
        at, col = np.nonzero(ahead >= 0)
        q, to = active[at], ahead[at, col]
        fresh = ~seen[q, to]
        at, col, q, to = at[fresh], col[fresh], q[fresh], to[fresh]
        seen[q, to] = True
        width = ahead.shape[1]
        found = np.full((len(active), width), -2, units.dtype)
        found[at, col] = likeness(units, queries[q], to)
        ids = np.where(found > -2, ahead, -1)
        all_near = np.concatenate([near[active], found], axis=1)
        all_held = np.concatenate([held[active], ids], axis=1)
        all_done = np.concatenate([done[active], found <= -2], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        held[active], near[active], done[active] = (np.take_along_axis(x, order, axis=1) for x in (all_held, all_near, all_done))


def pruned(units: np.ndarray, own: np.ndarray, places: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: of each vector's candidates (best first) the nearest, then those that no kept one is nearer to by `alpha`.

    Distances are the squares of Euclidean ones, 2 - 2 cos."""
    kept = np.full((len(own), degree), -1, np.int32)
    n = np.zeros(len(own), np.int64)
    alive = (places >= 0) & (places != own[:, None])
    away = 2 - 2 * near
    rows = np.arange(len(own))
    while True:
        going = rows[alive.any(axis=1) & (n < degree)]
        if not len(going):
            return kept
        pick = alive[going].argmax(axis=1)
        new = places[going, pick]
        kept[going, n[going]] = new
        n[going] += 1
        alive[going, pick] = False
        at, col = np.nonzero(alive[going])
        others = places[going[at], col]
        between = 2 - 2 * likeness(units, new[at], others)
        shadowed = alpha * alpha * between <= away[going[at], col]
        alive[going[at][shadowed | (others == new[at])], col[shadowed | (others == new[at])]] = False


def linked_back(units: np.ndarray, adjacent: np.ndarray, own: np.ndarray, most: int = MOST_DEGREE) -> None:
    """Add to `adjacent` the edges back from the neighbours of `own`; a vector with too many keeps what pruning leaves."""
    at, col = np.nonzero(adjacent[own] >= 0)
    back, to = adjacent[own][at, col], own[at]
    order = np.argsort(back, kind="stable")
    back, to = back[order], to[order]
    targets, starts = np.unique(back, return_index=True)
    for v, new in zip(targets, np.split(to, starts[1:]), strict=True):
        mine = adjacent[v]
        whole = np.union1d(mine[mine >= 0], new)
        if len(whole) > most:
            near = units[whole] @ units[v]
            order = np.argsort(-near, kind="stable")
            whole = pruned(units, np.array([v]), whole[order][None].astype(np.int32), near[order][None], most)[0]
            whole = whole[whole >= 0]
        adjacent[v] = -1
        adjacent[v, : len(whole)] = whole


def build(units: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The graph of `units`: each vector's neighbours, -1 where there are fewer than MOST_DEGREE.

    Vectors come in batches that double, the medoid first; a batch is searched in the graph so far and in itself."""
    n, start = len(units), medoid(units)
    adjacent = np.full((n, MOST_DEGREE), -1, np.int32)
    order = np.concatenate([[start], np.delete(np.arange(n), start)]).astype(np.int32)
    at = 1
    while at < n:
        batch = order[at : at + max(16, at)]
        places, near, _ = search(units, adjacent, start, batch, beam)
        # a batch's members do not see each other in the graph: each also gets the nearest of a stretch of them
        for lo in range(0, len(batch), 128):
            part = batch[lo : lo + 128]
            likes = units[part] @ units[part].T
            np.fill_diagonal(likes, -2)
            top = np.argsort(-likes, axis=1, kind="stable")[:, :beam]
            mine = np.concatenate([places[lo : lo + 128], part[top]], axis=1)
            likes = np.concatenate([near[lo : lo + 128], np.take_along_axis(likes, top, axis=1)], axis=1)
            best = np.argsort(-likes, axis=1, kind="stable")
            kept = pruned(units, part, np.take_along_axis(mine, best, axis=1), np.take_along_axis(likes, best, axis=1))
            adjacent[part, : kept.shape[1]] = kept
        linked_back(units, adjacent, batch)
        at += len(batch)
    return adjacent


def in_range(units: np.ndarray, adjacent: np.ndarray, start: int, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (a < b) whose cosine is about `least` or more, as the graph's searches find them.

    Each vector is searched greedily from `start`; then whatever lies within the range is expanded until the range
    holds nothing that is not."""
    n = len(units)
    queries = np.arange(n, dtype=np.int32)
    places, near, seen = search(units, adjacent, start, queries, beam)
    q, col = np.nonzero((near >= least) & (places >= 0))
    to = places[q, col]
    seen[:] = False  # what the beam had no room for is met again
    seen[q, to] = True
    found = [q.astype(np.int64) * n + to]
    while len(q):
        more = []
        for at in range(0, len(q), CHUNK):
            ahead = adjacent[to[at : at + CHUNK]]
            i, j = np.nonzero(ahead >= 0)
            fresh, other = q[at : at + CHUNK][i], ahead[i, j]
            new = ~seen[fresh, other]
            cells = np.unique(fresh[new].astype(np.int64) * n + other[new])
            fresh, other = cells // n, cells % n
            seen[fresh, other] = True
            hit = likeness(units, fresh, other) >= least
            more.append(cells[hit])
        cells = np.concatenate(more)
        found.append(cells)
        q, to = cells // n, cells % n
    cells = np.concatenate(found)
    a, b = cells // n, cells % n
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    cells = np.unique(lo[a != b] * n + hi[a != b])
    return cells // n, cells % n
