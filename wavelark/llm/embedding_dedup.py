"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Centres are fitted on a bounded sample. Each vector is built into the shards of its OVERLAP nearest centres: there it is joined to
those of its candidates (its nearest ones, and some from all over the shard) that no nearer neighbour covers, and the adjacency
lists that it gets in its shards are united. A cell's vectors and the edges between them are packed into blocks, a row each, so
blocks meet from the table itself (a Cartesian product of rows) and no vector is copied to where it asks. A block is searched by
its own vectors and by those of other blocks that can have a link there: none is ruled out but by a bound, from the border between
the cells (`reachable`) and then from the vectors' leading coordinates (`outline`), so no pair that can link is out of reach. The
search is greedy and expands with its range: from the shard's medoids, one of each connected part at least, and from the vector's
own place, it follows the `beam` best vectors met, and all that are in range. Vectors near one another search together. Each block
of a search audits itself: AUDIT of its vectors are compared in full, and where one link of theirs was missed, the whole block is.
Every link is verified in double precision. `audit_recall` compares a result with brute force. Equal vectors are one node and count
by their number. Vectors of floats are kept as floats and scaled to length 1 where they are read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.common import discard, materialize, releasing
from wavelark.llm.components import connected_components

LEAST = 0.95
#: Vectors that centres are fitted on; vectors meant for a shard; most centres (reached at 8 billion vectors).
SAMPLE, SHARD, MOST_CENTRES = 20_000, 2_000, 4_096
#: Vectors of a block, as a multiple of a shard.
BLOCK = 1.5
#: Leading coordinates of `outline`, and by how much its single-precision bound may be too low.
OUTLINE, SLACK = 32, 1e-5
#: Blocks that a task keeps unpacked, and pairs of blocks that go to Python at once.
OPEN, PAIRS = 32, 4
#: Shards that a vector is built into, and the graph: neighbours at most, nearest candidates, others, and the pruning's slack.
OVERLAP, DEGREE, NEAREST, SPREAD, ALPHA = 2, 32, 40, 8, 1.2
#: Vectors that search together, best ones that each follows, and those of a block that are compared in full.
TOGETHER, BEAM, AUDIT = 128, 4, 32
#: audit_recall: parts of the rows that are asked for, and of those they are compared with.
GRID = 8


def plain_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles, and which rows hold no nulls and only finite components; the others become 0."""
    n = len(column)
    flat = column.flatten()
    if n and column.null_count == 0 and flat.null_count == 0 and len(flat) and (np.asarray(column.value_lengths()) == len(flat) // n).all():
        x = flat.to_numpy().astype(np.float64).reshape(n, -1)
        ok = np.isfinite(x).all(axis=1)
    else:
        lists = column.to_pylist()
        width = max((len(v) for v in lists if v is not None), default=0)
        x, ok = np.zeros((n, max(width, 1))), np.zeros(n, bool)
        for i, v in enumerate(lists):
            if v is not None and len(v) and all(c is not None for c in v):
                x[i, : len(v)] = v
                ok[i] = np.isfinite(x[i]).all()
    x[~ok] = 0
    return x, ok


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which rows are not zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        big = np.abs(x).max(axis=1, initial=0)
        x = x / np.where(big > 0, big, 1)[:, None]
        norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm > 0


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 in double precision, and which rows are usable (no nulls, finite, not zero)."""
    x, ok = plain_rows(column)
    x, some = scaled(x)
    return x, ok & some


def fit_centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        centres = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1)[:, None], centres)
    return centres


def _prepare(single: bool):
    """vec_id, unit (as floats: the vector itself, else at length 1) and a digest of it at length 1; null where it can't be used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2_000):
                part = batch.slice(first, 2_000)
                plain, ok = plain_rows(part.column(1))
                x, some = scaled(plain)
                ids = part.column(0)
                ok &= some & ~np.asarray(ids.is_null())
                x = np.ascontiguousarray(x + 0.0)
                kept = np.ascontiguousarray(plain + 0.0, np.float32) if single else x
                unit = [v.tobytes() if good else None for v, good in zip(kept, ok)]
                marks = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() if good else None for v, good in zip(x, ok)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(unit, pa.binary()), pa.array(marks, pa.binary())], ["vec_id", "unit", "print"])

    return run


def _matrix(column, single: bool = False) -> np.ndarray:  # noqa: ANN001
    rows = [np.frombuffer(v, np.float32 if single else np.float64) for v in column.to_pylist()]
    width = max((len(r) for r in rows), default=1)
    if all(len(r) == width for r in rows):
        out = np.stack(rows) if rows else np.zeros((0, width))
    else:
        out = np.zeros((len(rows), width), rows[0].dtype)
        for o, r in zip(out, rows):
            o[: len(r)] = r
    return scaled(out.astype(np.float64))[0] if single else out


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def reachable(x: np.ndarray, home: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """Which cells after its own can hold vectors that each vector links with.

    For u in cell h and v in cell c: v(h - c) <= 0, so where u(h - c) > 0 the angle between them is at least that of u with the
    plane between the cells, whose sine is u(h - c) / |h - c|. Linked vectors are at most arccos(least) apart, so none is lost.
    """
    reach = np.sqrt(1 - max(0.0, least) ** 2)
    square = (centres**2).sum(axis=1)
    s = x[:, : centres.shape[1]] @ centres.T
    apart = np.sqrt(np.maximum(square[home][:, None] + square - 2 * centres[home] @ centres.T, 0) + 1e-9)
    later = s[np.arange(len(s)), home][:, None] - s <= reach * apart + 1e-9
    return later & (np.arange(len(centres)) > home[:, None])


def _assign(centres: np.ndarray, overlap: int, least: float, single: bool = False, later: bool = True):
    """A vector's nearest centres (the first is its cell), and with `later` the later cells that it can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(_matrix(batch.column(1), single), centres.shape[1])
            near, within = [], []
            for a in range(0, len(x), 256):
                part = x[a : a + 256]
                order = np.argsort(-(part[:, : centres.shape[1]] @ centres.T), axis=1, kind="stable")[:, :overlap]
                near += order.tolist()
                if later:
                    within += [np.flatnonzero(r).tolist() for r in reachable(part, order[:, 0], centres, least)]
            out = {"rep": batch.column(0), "unit": batch.column(1), "copies": batch.column(2), "near": pa.array(near, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(out | ({"later": pa.array(within, pa.list_(pa.int32()))} if later else {}))

    return run


def candidates(x: np.ndarray, nearest: int, spread: int, seed: int = 3) -> np.ndarray:
    """For each row its nearest other rows and some rows from all over, the nearest first; -1 fills up."""
    n = len(x)
    far = np.sort(np.random.default_rng(seed).integers(0, n, (n, spread)), axis=1)
    far[:, 1:][far[:, 1:] == far[:, :-1]] = -1
    out = np.empty((n, min(nearest, n - 1) + spread), np.int64)
    for a in range(0, n, 256):
        rows = np.arange(a, min(n, a + 256))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -3
        k = min(nearest, n - 1)
        both = np.concatenate([np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n - 1 else np.tile(np.arange(n), (len(rows), 1))[np.arange(n) != rows[:, None]].reshape(len(rows), -1), far[rows]], axis=1)
        both[:, k:][(both[:, k:] == rows[:, None]) | (both[:, k:, None] == both[:, None, :k]).any(axis=2)] = -1
        cos = np.where(both >= 0, np.take_along_axis(s, np.maximum(both, 0), 1), -4)
        out[rows] = np.take_along_axis(both, np.argsort(-cos, axis=1, kind="stable"), 1)
    return out


def robust_prune(x: np.ndarray, choice: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (nearest first) those that no nearer one taken covers: alpha times as close to it as to the row."""
    n = len(choice)
    out = np.full((n, degree), -1, np.int64)
    for a in range(0, n, 128):
        cand = choice[a : a + 128]
        v = x[np.maximum(cand, 0)]
        own = 1 - np.matmul(v, x[a : a + 128][:, :, None])[:, :, 0]
        among = alpha * alpha * (1 - np.matmul(v, v.transpose(0, 2, 1)))  # cosine distances are squares of lengths
        free, taken = cand >= 0, np.zeros(len(cand), np.int64)
        rows = np.arange(len(cand))
        for j in range(cand.shape[1]):
            take = free[:, j] & (taken < degree)
            if take.any():
                out[a + rows[take], taken[take]] = cand[take, j]
                taken += take
                free &= ~(take[:, None] & (among[:, j] <= own))
    return out


def _build(table: pa.Table, single: bool = False) -> pa.Table:
    """The graph of a shard's block: for each vector the ids of its neighbours, with `centre` and `block` those of its own block."""
    table = table.sort_by("rep")
    ids, x = table["rep"].to_numpy(), _matrix(table["unit"], single)
    graph = robust_prune(x, candidates(x, NEAREST, SPREAD), DEGREE, ALPHA) if len(ids) > 1 else np.full((1, 1), -1)
    own = [c for c in ("centre", "block") if c in table.column_names]
    for c in own:
        place = table[c].to_numpy()
        graph = np.where(place[graph] == place[:, None], graph, -1)
    return pa.table({"rep": table["rep"]} | {c: table[c] for c in own} | {"edges": pa.array([ids[g[g >= 0]] for g in graph], pa.list_(pa.int64()))})


class Graph:
    """The edges between a block's vectors, followed both ways."""

    def __init__(self, ids: np.ndarray, lists: list[list[int]]) -> None:
        n = len(ids)
        source = np.repeat(np.arange(n), [len(x or ()) for x in lists])
        there = np.array([v for x in lists for v in x or ()], np.int64)
        at = np.minimum(np.searchsorted(ids, there), n - 1)
        inside = ids[at] == there if len(there) else np.zeros(0, bool)
        source, at = source[inside], at[inside]
        pairs = np.unique(np.concatenate([source * n + at, at * n + source]))
        self.source, self.to = pairs // n, pairs % n
        self.first = np.searchsorted(self.source, np.arange(n + 1))

    @classmethod
    def stored(cls, first: np.ndarray, to: np.ndarray) -> Graph:
        """From the edges of each node, as they were packed."""
        graph = cls.__new__(cls)
        graph.first, graph.to = first.astype(np.int64), to.astype(np.int64)
        graph.source = np.repeat(np.arange(len(first) - 1), np.diff(graph.first))
        return graph

    def neighbours(self, nodes: np.ndarray) -> np.ndarray:
        n = self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(self.first[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.to[at]

    def starts(self, x: np.ndarray) -> np.ndarray:
        """Medoids of the block's parts by k-means, and the least node of each connected component."""
        label = np.arange(len(x))
        while len(self.to):
            lower = label.copy()
            np.minimum.at(lower, self.source, label[self.to])
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        parts = fit_centres(x, max(1, min(128, int(np.sqrt(len(x))))), 4)
        return np.union1d(np.argmax(x @ parts.T, axis=0), np.unique(label))


def range_search(x: np.ndarray, graph: Graph, starts: np.ndarray, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of the graph each query links with, and which of them the queries met.

    What one query of the group meets all compare with. Followed are those that are among the `beam` best of a query so far, and
    all in range of one.
    """
    met, hits = np.zeros(len(x), bool), np.zeros((len(q), len(x)), bool)
    best = np.full((len(q), beam), -3.0)
    new = starts
    while len(new):
        met[new] = True
        cos = q @ x[new].T
        best = np.partition(np.concatenate([best, cos], axis=1), -beam, axis=1)[:, -beam:]
        follow = (cos >= np.minimum(best.min(axis=1), least)[:, None]).any(axis=0)
        if (cos > least - 1e-9).any():
            hits[:, new] = decide(cos, x[new], q, least)
        new = np.unique(graph.neighbours(new[follow]))
        new = new[~met[new]]
    return hits, met


def decide(cos: np.ndarray, x: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Which cosines are at least `least`; near the limit they are summed pair by pair, so the answer is symmetric."""
    hits = cos >= least
    r, c = np.nonzero(np.abs(cos - least) < 1e-9)
    if len(r):
        hits[r, c] = np.einsum("ij,ij->i", q[r], x[c]) >= least
    return hits


def block_links(x: np.ndarray, m: int, graph: Graph, queries: np.ndarray, least: float, beam: int = BEAM, audit: int = AUDIT, starts: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Which of the first m rows of x each query (a row of x) links with, and whether the audit found the search whole."""
    nodes, starts = x[:m], graph.starts(x[:m]) if starts is None else starts
    hits = np.zeros((len(queries), m), bool)
    order = np.argsort(np.argmax(x[queries] @ nodes[starts].T, axis=1), kind="stable")
    for a in range(0, len(order), TOGETHER):
        rows = order[a : a + TOGETHER]
        q = queries[rows]
        hits[rows], _ = range_search(nodes, graph, np.union1d(starts, q[q < m]), x[q], least, beam)
    inner = queries < m
    if inner.any():  # what one of two nodes found the other has found
        mine = queries[inner]
        hits[np.ix_(inner, mine)] |= hits[np.ix_(inner, mine)].T
    checked = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    whole = not (decide(x[queries[checked]] @ nodes.T, nodes, x[queries[checked]], least) & ~hits[checked]).any()
    if not whole:
        for a in range(0, len(queries), 256):
            q = x[queries[a : a + 256]]
            hits[a : a + 256] = decide(q @ nodes.T, nodes, q, least)
    return hits, whole


def _counted(ids: np.ndarray, copies: np.ndarray, m: int, queries: np.ndarray, hits: np.ndarray) -> pa.Table:
    """Links counted, and a spanning forest, of queries (rows of ids) with the first m rows."""
    totals, rep, other = np.zeros(len(ids), np.int64), [], []
    if hits.any():
        hits[queries < m] &= np.arange(m) < queries[queries < m][:, None]  # each pair once
        totals[queries] += hits @ copies[:m]
        totals[:m] += copies[queries] @ hits
        label = np.arange(len(ids))
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            met = np.flatnonzero(hits[i])
            apart, first = np.unique(label[met], return_index=True)
            for l, at in zip(apart.tolist(), met[first].tolist()):
                if l != label[queries[i]]:
                    rep.append(int(ids[queries[i]]))
                    other.append(int(ids[at]))
                    label[label == l] = label[queries[i]]
    some = np.flatnonzero(totals)
    return pa.table({
        "rep": pa.array(np.concatenate([ids[some], np.array(rep, np.int64)]), pa.int64()),
        "n": pa.array(np.concatenate([totals[some], np.zeros(len(rep), np.int64)]), pa.int64()),
        "other": pa.array([None] * len(some) + other, pa.int64()),
    })


def _search(least: float, beam: int):
    """The vectors of a block against those that ask there, and in part 0 among themselves: links counted, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        is_node, part = table["role"].to_numpy() == 0, table["ask"][0].as_py()
        nodes, asks = table.filter(pa.array(is_node)).sort_by("rep"), table.filter(pa.array(~is_node)).sort_by("rep")
        m = len(nodes)
        ids = np.concatenate([nodes["rep"].to_numpy(), asks["rep"].to_numpy()])
        copies = np.concatenate([nodes["copies"].to_numpy(), asks["copies"].to_numpy()])
        queries = np.arange(0 if part == 0 else m, len(ids))
        hits = np.zeros((len(queries), m), bool)
        if m and len(queries):
            x = _matrix(pa.concat_arrays([c for t in (nodes, asks) for c in t["unit"].chunks]))
            hits, _ = block_links(x, m, Graph(ids[:m], nodes["edges"].to_pylist()), queries, least, beam)
        return _counted(ids, copies, m, queries, hits)

    return run


def outline(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The coordinates along some orthonormal axes and the length of what is left, in single precision.

    The cosine of two vectors is at most the product of their outlines: what is left of them adds the product of its lengths at most.
    """
    lead = x[:, : len(axes)] @ axes[: x.shape[1]]
    left = np.sqrt(np.maximum(1 - (lead * lead).sum(axis=1), 0))
    return np.concatenate([lead, left[:, None]], axis=1).astype(np.float32)


def leading_axes(x: np.ndarray, most: int = OUTLINE) -> np.ndarray:
    """The directions in which a sample is longest, as columns."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :most]


BLOCK_COLUMNS = "centre int, block int, ids binary, copies binary, unit binary, first binary, to binary, starts binary, later array<int>"


def _pack(centres: np.ndarray, least: float, single: bool):
    """One row of a block's vectors and of the edges between them, with the later cells that one of them can reach."""

    def run(table: pa.Table) -> pa.Table:
        is_node = np.asarray(table["unit"].is_valid())
        nodes, edges = table.filter(pa.array(is_node)).sort_by("rep"), table.filter(pa.array(~is_node))
        ids, m = nodes["rep"].to_numpy(), len(nodes)
        lists: list[list[int]] = [[] for _ in range(m)]
        for at, more in zip(np.searchsorted(ids, edges["rep"].to_numpy()).tolist(), edges["edges"].to_pylist()):
            lists[at] = lists[at] + more
        graph, x = Graph(ids, lists), _matrix(nodes["unit"], single)
        home = np.full(m, table["centre"][0].as_py())
        later = np.zeros(len(centres), bool)
        for a in range(0, m, 256):
            later |= reachable(_padded(x[a : a + 256], centres.shape[1]), home[a : a + 256], centres, least).any(axis=0)
        raw = [np.frombuffer(v, np.float32 if single else np.float64) for v in nodes["unit"].to_pylist()]
        flat = np.zeros((m, max(map(len, raw))), raw[0].dtype)
        for o, r in zip(flat, raw):
            o[: len(r)] = r
        packed = [ids.astype(np.int64), nodes["copies"].to_numpy().astype(np.int64), flat, graph.first.astype(np.int64), graph.to.astype(np.uint16 if m <= 1 << 16 else np.int32), graph.starts(x).astype(np.int32)]
        own = [pa.array([table[c][0].as_py()], pa.int32()) for c in ("centre", "block")]
        return pa.Table.from_arrays([*own, *[pa.array([a.tobytes()], pa.binary()) for a in packed], pa.array([np.flatnonzero(later).tolist()], pa.list_(pa.int32()))], [c.split()[0] for c in BLOCK_COLUMNS.split(", ")])

    return run


class Block:
    """A packed block, opened."""

    def __init__(self, row: dict, axes: np.ndarray, single: bool) -> None:
        self.centre, self.ids, self.copies = row["centre"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
        m = len(self.ids)
        flat = np.frombuffer(row["unit"], np.float32 if single else np.float64).reshape(m, -1)
        self.x = scaled(flat.astype(np.float64))[0] if single else flat
        self.outline = outline(self.x, axes)
        self.graph = Graph.stored(np.frombuffer(row["first"], np.int64), np.frombuffer(row["to"], np.uint16 if m <= 1 << 16 else np.int32))
        self.starts = np.frombuffer(row["starts"], np.int32)


def _asking(asks: Block, nodes: Block, centres: np.ndarray, least: float) -> np.ndarray:
    """The vectors of a block that can have a link in another one, or in their own where that is given twice."""
    rows = np.arange(len(asks.ids))
    if asks.centre != nodes.centre:
        two = centres[[asks.centre, nodes.centre]]
        rows = np.flatnonzero(reachable(_padded(asks.x, centres.shape[1]), np.zeros(len(rows), int), two, least)[:, 1])
    out = []
    for a in range(0, len(rows), 1024):
        part = rows[a : a + 1024]
        most = asks.outline[part] @ nodes.outline.T
        if asks is nodes:
            most[np.arange(len(part)), part] = -2
        out.append(part[most.max(axis=1) >= least - SLACK])
    return np.concatenate(out) if out else rows


def _meet(centres: np.ndarray, axes: np.ndarray, least: float, beam: int, single: bool):
    """Pairs of blocks (columns a_, b_): the vectors of the one that can have a link in the other search it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: OrderedDict = OrderedDict()

        def block(batch: pa.RecordBatch, i: int, side: str) -> Block:
            get = lambda c: batch.column(f"{side}_{c}")[i].as_py()
            key = get("centre"), get("block")
            if key not in opened:
                opened[key] = Block({c: get(c) for c in ("centre", "ids", "copies", "unit", "first", "to", "starts")}, axes, single)
            opened.move_to_end(key)
            while len(opened) > OPEN:
                opened.popitem(last=False)
            return opened[key]

        for batch in batches:
            for i in range(batch.num_rows):
                asks, nodes = sorted((block(batch, i, side) for side in ("a", "b")), key=lambda b: b.centre)
                rows, m = _asking(asks, nodes, centres, least), len(nodes.ids)
                if not len(rows):
                    continue
                if asks is nodes:
                    x, ids, copies, queries = nodes.x, nodes.ids, nodes.copies, rows
                else:
                    width = max(nodes.x.shape[1], asks.x.shape[1])
                    x = np.concatenate([_padded(nodes.x, width), _padded(asks.x[rows], width)])
                    ids, copies = np.concatenate([nodes.ids, asks.ids[rows]]), np.concatenate([nodes.copies, asks.copies[rows]])
                    queries = np.arange(m, m + len(rows))
                hits, _ = block_links(x, m, nodes.graph, queries, least, beam, starts=nodes.starts)
                yield from _counted(ids, copies, m, queries, hits).to_batches()

    return run


@releasing
def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, shard: int = SHARD, overlap: int = OVERLAP, beam: int = BEAM, sample: int = SAMPLE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors are linked where their cosine in double precision is at least `least`. Vectors that are null, empty or zero, or hold
    null or non-finite components, and rows with a null id link with nothing; a null id gives a null component and is kept.
    Vectors of different lengths are compared as if zeros followed. Repeated rows count as vectors of their own for n_links and
    share an id and so a component; ids are meant to be unique among different vectors. An empty table gives no rows.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    ready = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<float>" if single else "array<double>").alias("v"))
    ready = materialize(ready.mapInArrow(_prepare(single), "vec_id long, unit binary, print binary"))
    nodes = materialize(ready.where("unit is not null").groupBy("print").agg(F.min("vec_id").alias("rep"), F.min_by("unit", "vec_id").alias("unit"), F.count("*").alias("copies")))
    n = nodes.count()
    if n == 0:
        return ready.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    everyone = materialize(ready.select("vec_id", "print"))
    reps = materialize(nodes.select("print", "rep", "copies"))
    discard(ready)

    k = min(MOST_CENTRES, max(1, round(n / (BLOCK * shard))))
    fitted = _matrix(nodes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("unit").toArrow()["unit"], single)  # a bounded sample
    centres, axes = fit_centres(fitted, min(k, len(fitted))), leading_axes(fitted)
    rows = materialize(nodes.select("rep", "unit", "copies").mapInArrow(_assign(centres, overlap, least, single, later=False), "rep long, unit binary, copies long, near array<int>"))
    discard(nodes)
    sizes = rows.groupBy(F.get("near", F.lit(0)).alias("centre")).agg(F.greatest(F.round(F.count("*") / (BLOCK * shard)), F.lit(1)).cast("int").alias("blocks"))
    sizes = F.broadcast(materialize(sizes))  # MOST_CENTRES rows
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = rows.withColumn("centre", F.get("near", F.lit(0))).join(sizes, "centre").withColumn("block", block).drop("blocks")
    built = placed.select("rep", "unit", "centre", "block", F.explode("near").alias("shard")).join(sizes.withColumnRenamed("centre", "shard"), "shard")
    built = built.select("rep", "unit", "centre", "block", "shard", block.alias("part")).groupBy("shard", "part")
    edges = materialize(built.applyInArrow(lambda t: _build(t, single), "rep long, centre int, block int, edges array<long>"))
    packed = placed.select("centre", "block", "rep", "unit", "copies", F.lit(None).cast("array<long>").alias("edges"))
    packed = packed.unionByName(edges.select("centre", "block", "rep", F.lit(None).cast("binary").alias("unit"), F.lit(None).cast("long").alias("copies"), "edges"))
    blocks = materialize(packed.groupBy("centre", "block").applyInArrow(_pack(centres, least, single), BLOCK_COLUMNS))
    discard(rows)
    discard(edges)
    # each two blocks once, in either order so that tasks have equal shares
    a, b = (blocks.select(F.struct("centre", "block").alias(f"{side}_no"), *[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    first = F.pmod(F.xxhash64(F.least("a_no", "b_no"), F.greatest("a_no", "b_no")), F.lit(2)) == 0
    asked = F.when(F.col("a_centre") < F.col("b_centre"), F.array_contains("a_later", F.col("b_centre"))).otherwise(F.array_contains("b_later", F.col("a_centre")))
    once = (F.col("a_no") == F.col("b_no")) | ((F.col("a_no") != F.col("b_no")) & (first == (F.col("a_no") < F.col("b_no"))) & ((F.col("a_centre") == F.col("b_centre")) | asked))
    met = a.join(b.hint("shuffle_replicate_nl"), once).drop("a_no", "b_no", "a_later", "b_later")
    found = materialize(met.mapInArrow(_meet(centres, axes, least, beam, single), "rep long, n long, other long"), PAIRS)
    discard(blocks)
    counts = materialize(found.groupBy("rep").agg(F.sum("n").alias("n")))
    component = materialize(connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))))
    known = reps.join(counts, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("print", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = everyone.join(materialize(known), "print", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit_recall(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, every: int = 20) -> float:
    """Share of the true links that n_links counts, for the rows whose id is divisible by `every`, by brute force in blocks."""
    ready = materialize(vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(_prepare(False), "vec_id long, unit binary, print binary"))
    part = lambda salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(GRID)).cast("int")
    ready = ready.where("unit is not null")
    asked = ready.where(F.col("vec_id") % every == 0).select(part(1).alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("part"), "vec_id", "unit", F.lit(1).alias("role"))
    there = ready.select(part(2).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("ask"), "vec_id", "unit", F.lit(0).alias("role"))

    def brute(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        x = _matrix(table["unit"])
        ids = table["vec_id"].to_numpy()
        q, v = x[role == 1], x[role == 0]
        n = [decide(q[a : a + 256] @ v.T, v, q[a : a + 256], least).sum(axis=1) for a in range(0, len(q), 256)]
        return pa.table({"vec_id": pa.array(ids[role == 1], pa.int64()), "true": pa.array(np.concatenate(n).astype(np.int64) if n else [], pa.int64())})

    truth = asked.unionByName(there).groupBy("part", "ask").applyInArrow(brute, "vec_id long, true long").groupBy("vec_id").agg((F.sum("true") - 1).alias("true"))
    both = truth.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum("true").alias("true"), F.sum(F.least("true", "n_links")).alias("found")).first()
    return 1.0 if not both["true"] else both["found"] / both["true"]
