"""Bridges and trails inside one passage, for passages whose facts have no link to another one: a task makes them with arrays.

Rows come sorted by home (the passage) and fact; all facts of a home are one unit. They share its passage, so a pair's entity
overlap is 0 to 2 and its source overlap 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of facts that a task has in arrays at once: a bound of memory, not of results.
PAIRS_AT_ONCE = 1 << 20
KINDS = pa.array(["same_source_chain", "relation_continuation"])
NONE = np.iinfo(np.int32).max


class Units:
    """Units of similar size, padded to the greatest: which facts (rows of ``ids``), their order of preference, overlaps, relations."""

    def __init__(self, ids: pa.Array, rows: np.ndarray, sizes: np.ndarray, s: np.ndarray, o: np.ndarray, r: np.ndarray, has: np.ndarray, per_fact: int):
        n = int(sizes.max())
        self.ids, self.n = ids, n
        at = np.arange(n)
        valid = at < sizes[:, None]
        self.row = np.where(valid, rows[:, None] + at, 0)
        s, o, self.r = s[self.row], o[self.row], r[self.row]
        has_s, has_o, self.has_r = (has[:, k][self.row] & valid for k in range(3))
        has_o &= ~(has_s & (s == o))
        same = lambda x, hx, y, hy: (x[:, :, None] == y[:, None, :]) & hx[:, :, None] & hy[:, None, :]
        crossed = same(s, has_s, o, has_o)
        self.overlap = same(s, has_s, s, has_s).astype(np.int8) + same(o, has_o, o, has_o) + crossed + crossed.transpose(0, 2, 1)
        pairs = valid[:, :, None] & valid[:, None, :] & (at[:, None] != at)
        #: more shared entities first, then the id
        self.order = (2 - self.overlap.astype(np.int32)) * n + at
        own = np.where(pairs, self.order, NONE)
        own = pairs & (own <= np.partition(own, per_fact - 1, axis=2)[:, :, per_fact - 1 : per_fact]) if per_fact < n else pairs
        self.linked = own | own.transpose(0, 2, 1)

    def named(self, unit: np.ndarray, at: np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(self.row[unit, at]))


def pairs(x: Units) -> list[pa.Array]:
    """left, right, kind, entity_overlap, source_overlap."""
    u, i, j = np.nonzero(x.linked & (np.arange(x.n)[:, None] < np.arange(x.n)))
    overlap = x.overlap[u, i, j].astype(np.int64)
    one_relation = (overlap > 0) & x.has_r[u, i] & x.has_r[u, j] & (x.r[u, i] == x.r[u, j])
    return [x.named(u, i), x.named(u, j), KINDS.take(pa.array(one_relation.astype(np.int8))), pa.array(overlap), pa.array(np.ones(len(u), np.int64))]


def _trails(x: Units, neighbours: int, per_start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """unit, start, middle, end, place of every trail."""
    steps = np.where(x.linked, x.order, NONE)
    k = min(neighbours, x.n)
    steps = np.sort(np.partition(steps, k - 1, axis=2)[:, :, :k] if k < x.n else steps, axis=2)
    there, to = steps < NONE, steps % x.n
    units, at = len(steps), np.arange(x.n)
    unit = np.arange(units)[:, None, None]
    end, ok = to[unit, to], there[unit, to] & there[:, :, :, None] & (to[unit, to] != at[:, None, None])
    ok = ok.reshape(units, x.n, k * k)
    place = np.cumsum(ok, axis=2)
    ok &= place <= per_start
    u, start, c = np.nonzero(ok)
    return u, start, to[u, start, c // k], end.reshape(units, x.n, k * k)[u, start, c], place[u, start, c]


def trails(neighbours: int, per_start: int) -> Callable[[Units], list[pa.Array]]:
    """start, middle, end, place."""

    def made(x: Units) -> list[pa.Array]:
        u, start, middle, end, place = _trails(x, neighbours, per_start)
        return [x.named(u, start), x.named(u, middle), x.named(u, end), pa.array(place.astype(np.int64))]

    return made


def membership(neighbours: int, per_start: int) -> Callable[[Units], list[pa.Array]]:
    """fact, trails, facts, passages; the facts of a unit are of one passage."""

    def made(x: Units) -> list[pa.Array]:
        u, *on, _ = _trails(x, neighbours, per_start)
        counts = sum(np.bincount(u * x.n + a, minlength=x.linked.shape[0] * x.n) for a in on).reshape(-1, x.n)
        met = np.zeros(x.linked.shape, bool)
        for a in on:
            for b in on:
                met[u, a, b] = True
        unit, at = np.nonzero(counts)
        return [x.named(unit, at), pa.array(counts[unit, at].astype(np.int64)), pa.array(met.sum(axis=2)[unit, at].astype(np.int64)), pa.array(np.ones(len(unit), np.int64))]

    return made


def endpoints(neighbours: int, per_start: int) -> Callable[[Units], list[pa.Array]]:
    """fact, other, trails."""

    def made(x: Units) -> list[pa.Array]:
        u, start, _, end, _ = _trails(x, neighbours, per_start)
        size = x.linked.size
        counts = (np.bincount((u * x.n + start) * x.n + end, minlength=size) + np.bincount((u * x.n + end) * x.n + start, minlength=size)).reshape(x.linked.shape)
        u, i, j = np.nonzero(counts)
        return [x.named(u, i), x.named(u, j), pa.array(counts[u, i, j].astype(np.int64))]

    return made


def maker(per_fact: int, made: Callable[[Units], list[pa.Array]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows home, fact, r, s, o (all but the fact are numbers), sorted by home and fact."""

    def of(table: pa.Table, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = table.column("fact").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        once = np.r_[True, (home[1:] != home[:-1]) | pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)]
        if not once.all():
            table, home, ids = table.filter(pa.array(once)), home[once], ids.filter(pa.array(once))
        columns = [table.column(c).combine_chunks() for c in ("s", "o", "r")]
        has = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], 1)
        s, o, r = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in columns)
        first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        sizes = np.diff(np.r_[first, len(home)])
        first, sizes = first[sizes > 1], sizes[sizes > 1]
        bucket = (sizes + 7) // 8
        for b in np.unique(bucket):
            rows, size = first[bucket == b], sizes[bucket == b]
            step = max(1, PAIRS_AT_ONCE // (8 * int(b)) ** 2)
            for i in range(0, len(rows), step):
                yield pa.RecordBatch.from_arrays(made(Units(ids, rows[i : i + step], size[i : i + step], s, o, r, has, per_fact)), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            home = table.column("home").to_numpy()
            last = int(np.searchsorted(home, home[-1]))  # the last home may go on in the next batch
            if last:
                yield from of(table.slice(0, last), home[:last])
            rest = table.slice(last)
        if rest is not None:
            yield from of(rest, rest.column("home").to_numpy())

    return run
