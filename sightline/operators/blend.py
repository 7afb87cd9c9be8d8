"""Hosts like an asset: the matches of all its queries blended where they are found (``walk.py``)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sightline.operators.walk import NONE, STEP, UNIT, Best, NearestRows, by_space, distances, firsts, numbered, ranks, unit_rows


def _owners(left: pa.Table, columns: Sequence[str]) -> pa.Table:
    """``left`` with the rows of one asset together, by query position, and the asset's number as ``_owner``."""
    left = left.take(pc.sort_indices(left, sort_keys=[(c, "ascending") for c in (*columns, "query_pos")]))
    changed = np.zeros(left.num_rows, bool)
    for column in columns:
        changed |= firsts(ranks(left[column]))
    return left.append_column("_owner", pa.array(np.cumsum(changed) - 1))


class BlendedHosts(NearestRows):
    """One row for each asset and host: the ``k`` nearest rows of each query, those in scope and of other hosts, the
    best of each host, and the weighted mean similarity over the queries that hit.

    ``host_type`` names the corpus's hosts where an asset may not find itself. ``most``: so many of each role,
    by distance and host.
    """

    def __init__(self, left, k, names, *, host_type: str | None, bonus: tuple[float, float], most: int | None = None):
        left = _owners(left, ("asset_type", "asset_id"))
        super().__init__(left, k, names)
        self.host_type, self.bonus, self.most = host_type, bonus, most

    def results(self):
        rows, left = self.rows(), self.left
        ties = [(c, "ascending") for c in ("section_index", "start_seconds", "embedding_id")]
        order = pc.sort_indices(rows, sort_keys=ties, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        host, section = ranks(rows["host_id"]), rows["section_index"].to_numpy()
        owner, weight, role = left["_owner"].to_numpy(), left["weight"].to_numpy(), ranks(left["role"])
        roles = int(role.max()) + 1
        scope = np.array([{"asset": 0, "section": 1}.get(s, 2) for s in left["scope"].to_pylist()])
        typed = np.array([t == self.host_type for t in left["asset_type"].to_pylist()])
        # The number of an asset among the corpus's hosts, or none.
        known = dict(zip(rows["host_id"].to_pylist(), host.tolist()))
        own = np.array([known.get(a, -1) for a in left["asset_id"].to_pylist()])
        own[~typed] = -1
        ends = np.flatnonzero(np.append(np.diff(owner) != 0, True)) + 1
        begin = 0
        while begin < len(owner):
            stop = int(ends[np.searchsorted(ends, min(begin + 64, len(owner)))])  # whole assets
            numbers = np.sort(self.best[begin:stop], axis=1)
            at, column = np.nonzero(numbers != NONE)
            numbers, q = numbers[at, column], at + begin
            begin = stop
            r, units = numbers & 0xFFFFFFFF, numbers >> 32
            fits = np.where(scope[q] == 0, section[r] == 0, (scope[q] == 2) | (section[r] > 0)) & (host[r] != own[q])
            q, r, units = q[fits], r[fits], units[fits]
            order = np.lexsort((place[r], units, host[r], q))
            order = order[firsts(q[order], host[r[order]])]
            q, r, units = q[order], r[order], units[order]
            weighted = np.clip(1 - units / UNIT, -1.0, 1.0) * weight[q]
            order = np.lexsort((q, -weighted, host[r], owner[q]))
            q, r, weighted = q[order], r[order], weighted[order]
            starts = np.flatnonzero(firsts(owner[q], host[r])) if len(q) else np.zeros(0, np.int64)
            if not len(starts):
                continue
            several = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(q))))
            hit = np.zeros((len(starts), roles), bool)
            hit[several, role[q]] = True
            count = hit.sum(axis=1)
            total = np.add.reduceat(weight[q], starts)
            mean = np.add.reduceat(weighted, starts) / total
            step, cap = self.bonus
            distance = np.floor(np.clip(1 - mean - np.minimum(cap, (count - 1) * step), 0.0, 2.0) * UNIT + 0.5) / UNIT  # halves go up, as in SQL
            q, r = q[starts], r[starts]
            if self.most:
                order = np.lexsort((host[r], distance, role[q], owner[q]))
                heads = np.flatnonzero(firsts(owner[q[order]], role[q[order]]))
                turn = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
                few = order[turn < self.most]
                q, r, distance, count = q[few], r[few], distance[few], count[few]
            asked, found = left.take(pa.array(q)), rows.take(pa.array(r))
            columns = {c: asked[c] for c in ("asset_type", "asset_id", "role")} | {c: found[c] for c in found.schema.names}
            made = {c: v.combine_chunks() for c, v in columns.items()}
            made |= {"distance": pa.array(distance), "role_count": pa.array(count.astype(np.int64))}
            yield pa.RecordBatch.from_arrays([made[c] for c in self.names], names=list(self.names))


class MeanHosts(Best):
    """The ``k`` hosts with the least weighted mean, over an asset's queries, of the distance of the host's best row.

    The corpus comes past by host; of equal rows the earlier one counts.
    """

    def __init__(self, left: pa.Table, k: int, names: Sequence[str]):
        left = _owners(left, ("asset_id",))
        owner = left["_owner"].to_numpy()
        super().__init__(int(owner[-1]) + 1, k)
        self.names, self.waiting = names, None
        self.weight, self.starts = left["weight"].to_numpy(), np.flatnonzero(firsts(owner))
        self.ends = np.append(self.starts[1:], len(owner))
        self.assets = left["asset_id"].combine_chunks().take(pa.array(self.starts))
        self.spaces = {s: (at, unit_rows(left["_vector"].take(pa.array(at)))) for s, at in by_space(left["_space"])}

    def add(self, rows: pa.Table) -> None:
        if self.waiting is not None:
            rows = pa.concat_tables([self.waiting, rows])
        # The last host may go on in the next batch.
        last = int(np.flatnonzero(firsts(ranks(rows["host_id"])))[-1])
        self.waiting = rows.slice(last)
        if last:
            self._meet(rows.slice(0, last).combine_chunks())

    def _meet(self, rows: pa.Table) -> None:
        base = self.keep(rows)
        host = np.cumsum(firsts(ranks(rows["host_id"]))) - 1
        hosts = int(host[-1]) + 1
        names = rows["host_id"].combine_chunks().take(pa.array(np.flatnonzero(firsts(host))))
        own = pc.index_in(self.assets, value_set=names).to_numpy(zero_copy_only=False)
        spaces = []
        for space, at in by_space(rows["_space"]):
            if space in self.spaces:
                cuts = np.flatnonzero(firsts(host[at]))
                spaces.append((*self.spaces[space], at, unit_rows(rows["_vector"].take(pa.array(at))), cuts))
        begin = 0
        while begin < len(self.starts):
            low = self.starts[begin]
            stop = max(begin + 1, int(np.searchsorted(self.ends, low + STEP, side="right")))
            high = self.ends[stop - 1]
            nearest = np.full((high - low, hosts), np.inf)
            holder = np.zeros((high - low, hosts), np.int64)
            for mine, queries, at, vectors, cuts in spaces:
                inside = np.flatnonzero((mine >= low) & (mine < high))
                if not len(inside):
                    continue
                units = distances(queries[inside], vectors)
                if len(cuts) < len(at):
                    least = np.minimum.reduceat(units, cuts, axis=1)
                    sizes = np.diff(np.append(cuts, len(at)))
                    first = np.where(units == np.repeat(least, sizes, axis=1), np.arange(len(at)), len(at))
                    first = np.minimum.reduceat(first, cuts, axis=1)
                else:
                    least, first = units, np.broadcast_to(np.arange(len(at)), units.shape)
                # A query and a host meet in one space for each scope: the nearer of several counts, the earlier on a tie.
                cell = np.ix_(mine[inside] - low, host[at[cuts]])
                better = (least < nearest[cell]) | ((least == nearest[cell]) & (at[first] < holder[cell]))
                nearest[cell] = np.where(better, least, nearest[cell])
                holder[cell] = np.where(better, at[first], holder[cell])
            starts, weight = self.starts[begin:stop] - low, self.weight[low:high, None]
            found = np.isfinite(nearest)
            total = np.add.reduceat(np.where(found, weight, 0.0), starts, axis=0)
            summed = np.add.reduceat(np.where(found, nearest, 0.0) / UNIT * weight, starts, axis=0)
            sizes = self.ends[begin:stop] - self.starts[begin:stop]
            least = np.repeat(np.minimum.reduceat(nearest, starts, axis=0), sizes, axis=0)
            best = np.where(nearest == least, np.arange(high - low)[:, None], high - low)
            best = np.minimum.reduceat(best, starts, axis=0)
            place = holder[best, np.arange(hosts)] + base
            met = total > 0
            mean = np.floor(np.divide(summed, total, out=np.zeros_like(summed), where=met) * UNIT + 0.5)
            met[np.flatnonzero(own[begin:stop] >= 0), own[begin:stop][own[begin:stop] >= 0].astype(np.int64)] = False
            self.offer(np.arange(begin, stop), np.where(met, numbered(mean, place), NONE))
            begin = stop

    def results(self):
        if self.waiting is not None:
            self._meet(self.waiting.combine_chunks())
        rows = self.rows()
        for targets, places, units in self.found():
            begins = np.flatnonzero(firsts(targets))
            position = np.arange(len(targets)) - np.repeat(begins, np.diff(np.append(begins, len(targets)))) + 1
            taken = rows.take(pa.array(places))
            columns = {c: taken[c].combine_chunks() for c in taken.schema.names}
            columns |= {"asset_id": self.assets.take(pa.array(targets)), "distance": pa.array(units / UNIT), "position": pa.array(position.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], names=list(self.names))
