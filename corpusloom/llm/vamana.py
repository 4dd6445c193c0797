"""A robust-pruned directed graph over the vectors of one shard, and beam search on it, for whole batches at once.

Every step handles all queries of a batch together: one gather of neighbours, one batched product, one partition. Vectors
are of length one, so similarity is the inner product and the squared distance 2 - 2 * similarity.
"""

from __future__ import annotations

import numpy as np

NONE = -1
#: Nodes that every search without a start of its own begins with.
ENTRIES = 192


class Graph:
    """degree: out-edges kept by pruning; beam: width of the searches that propose neighbours; alpha: relaxation of pruning.

    note: proposals of at least this similarity are kept for ``proposed``.
    """

    def __init__(self, x: np.ndarray, degree: int = 14, beam: int = 28, alpha: float = 1.2, note: float = -1.0, seed: int = 7):
        self.x, self.degree, self.beam, self.alpha2, self.note = x, degree, beam, alpha * alpha, note
        n = len(x)
        self.out = np.full((n, degree), NONE, np.int32)
        self.deg = np.zeros(n, np.int32)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.entries = order[: max(1, min(n, ENTRIES))]
        self.met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # what the searches of the build proposed
        self._build(order)

    # -- building ---------------------------------------------------------------------------------------------
    def _build(self, order: np.ndarray) -> None:
        first = order[: min(len(order), 256)]
        if len(first) > 1:
            sims = self.x[first] @ self.x[first].T
            np.fill_diagonal(sims, -2)
            c = min(len(first) - 1, self.beam + 8)
            near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
            self._link(first, first[near], np.take_along_axis(sims, near, 1))
        done = len(first)
        while done < len(order):
            batch = order[done : done + min(1024, done)]
            ids, sims = self.search(self.x[batch], self.beam)
            self._link(batch, ids, sims)
            done += len(batch)

    def proposed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, node, similarity) of all candidates that the searches of the build met, in both directions."""
        if not self.met:
            return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32)
        a, b, s = (np.concatenate([m[i] for m in self.met]) for i in range(3))
        return np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])

    def _link(self, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        """Out-edges of new nodes from their candidates, and the edges back."""
        r, c = np.nonzero((cand != NONE) & (sims > max(-1.5, self.note)))
        self.met.append((nodes[r], cand[r, c], sims[r, c]))
        kept = self._prune(cand, sims)
        self.out[nodes], self.deg[nodes] = kept, (kept != NONE).sum(1)
        src = np.repeat(nodes, (kept != NONE).sum(1))
        dst = kept[kept != NONE]
        by = np.argsort(dst, kind="stable")
        dst, src = dst[by], src[by]
        targets, start, count = np.unique(dst, return_index=True, return_counts=True)
        slot = np.arange(len(dst)) - np.repeat(start, count) + self.deg[dst]
        room = np.repeat(self.deg[targets] + count <= self.degree, count)
        self.out[dst[room], slot[room]] = src[room]
        fits = self.deg[targets] + count <= self.degree
        self.deg[targets[fits]] += count[fits]
        full, start, count = targets[~fits], start[~fits], count[~fits]
        if not len(full):
            return
        # rows that overflow are pruned anew over their old and new edges
        width = int(count.max())
        new = np.full((len(full), width), NONE, np.int32)
        col = np.arange(width)
        has = col < count[:, None]
        new[has] = src[(start[:, None] + col)[has]]
        both = np.concatenate([self.out[full], new], axis=1)
        sims = np.einsum("bd,bkd->bk", self.x[full], self.x[both])
        sims[both == NONE] = -2
        sims[both == full[:, None]] = -2
        kept = self._prune(both, sims)
        self.out[full], self.deg[full] = kept, (kept != NONE).sum(1)

    def _prune(self, cand: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Keep the nearest candidate, drop those much nearer to it than to the node, and go on: at most ``degree`` each."""
        c = min(cand.shape[1], self.beam + 8)
        by = np.argsort(-sims, axis=1)[:, :c]
        cand, sims = np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1)
        v = self.x[cand]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        dist = 2 - 2 * sims
        covers = between * self.alpha2 <= dist[:, None, :]  # i covers j
        alive = sims > -1.5
        out = np.full((len(cand), self.degree), NONE, np.int32)
        rows = np.arange(len(cand))
        filled = np.zeros(len(cand), np.int32)
        for i in range(c):
            take = alive[:, i] & (filled < self.degree)
            if not take.any():
                continue
            r = rows[take]
            out[r, filled[r]] = cand[r, i]
            filled[r] += 1
            alive[r] &= ~covers[r, i]
        return out

    # -- searching --------------------------------------------------------------------------------------------
    def search(self, q: np.ndarray, beam: int, start: np.ndarray | None = None, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of every row of ``q``: ids and similarities of the ``beam`` best nodes met, unordered; -1 and -2 where there are fewer.

        start: (rows, s) nodes to begin with; else the common entries. expand: nodes of the beam expanded at a time.
        """
        m, n = len(q), len(self.x)
        seen = np.zeros((m, n), bool)
        first = np.broadcast_to(self.entries, (m, len(self.entries))) if start is None else start
        sims = q @ self.x[self.entries].T if start is None else np.einsum("bd,bkd->bk", q, self.x[first])
        if start is not None:
            sims[first == NONE] = -2
        rows = np.arange(m)
        seen[rows[:, None], first] = True
        ids = np.full((m, beam + first.shape[1]), NONE, np.int32)
        val = np.full(ids.shape, -2, np.float32)
        ids[:, : first.shape[1]], val[:, : first.shape[1]] = first, sims
        if ids.shape[1] > beam:
            top = np.argpartition(-val, beam - 1, axis=1)[:, :beam]
            ids, val = np.take_along_axis(ids, top, 1), np.take_along_axis(val, top, 1)
        open_ = val > -1.5
        out_ids, out_val = ids.copy(), val.copy()
        live = rows  # queries that aren't done; the arrays below are of these only
        while len(live):
            score = np.where(open_, val, -3)
            pick = np.argpartition(-score, expand - 1, axis=1)[:, :expand] if expand < beam else np.argsort(-score, axis=1)
            ok = np.take_along_axis(open_, pick, 1)
            todo = ok.any(1)
            if not todo.all():
                out_ids[live[~todo]], out_val[live[~todo]] = ids[~todo], val[~todo]
                live, ids, val, open_, pick, ok, q = live[todo], ids[todo], val[todo], open_[todo], pick[todo], ok[todo], q[todo]
                if not len(live):
                    break
            r = np.arange(len(live))[:, None]
            open_[r, pick] = False
            at = np.where(ok, ids[r, pick], NONE)
            nb = self.out[at]
            nb[at == NONE] = NONE
            nb = nb.reshape(len(live), -1)
            # a node counts once: not seen before, and of several places in this row the one marked last
            fresh = (nb != NONE) & ~seen[live[:, None], nb]
            fr, fc = np.nonzero(fresh)
            node = nb[fr, fc]
            key = fr.astype(np.int64) * n + node
            _, once = np.unique(key, return_index=True)
            fr, node = fr[once], node[once]
            seen[live[fr], node] = True
            sim = np.einsum("ij,ij->i", q[fr], self.x[node])
            count = np.bincount(fr, minlength=len(live))
            width = int(count.max()) if len(fr) else 0
            if width == 0:
                continue
            col = np.arange(len(fr)) - np.repeat(np.cumsum(count) - count, count)
            more = np.full((len(live), width), NONE, np.int32)
            mval = np.full((len(live), width), -2, np.float32)
            more[fr, col], mval[fr, col] = node, sim
            ids, val = np.concatenate([ids, more], 1), np.concatenate([val, mval], 1)
            open_ = np.concatenate([open_, mval > -1.5], 1)
            top = np.argpartition(-val, beam - 1, axis=1)[:, :beam]
            ids, val, open_ = (np.take_along_axis(a, top, 1) for a in (ids, val, open_))
        return out_ids, out_val
