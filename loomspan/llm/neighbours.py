"""Most similar vectors for every vector (problem 5).

NN-descent: a first neighbour graph comes from a few partitions of space into cells, whose vectors are
compared in blocks; then rounds of Spark joins bring together, at each vector, all that it names and all
that name it, which may be neighbours of each other, until a round changes hardly an edge. Edges that
haven't met yet are fresh, and only pairs with a fresh edge are compared. New queries are answered by
greedy search over the graph.

Vectors travel as codes of one byte per dimension, which keep a cosine within about 0.004. Nothing but
the landmarks of cells, bounded by a sample, is sent to all tasks. Each vector has a bounded number of
rows in every stage, and blocks are bounded, so work grows in proportion to the vectors.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.common import cut, cut_counting, spill

DIMENSIONS = 64
KEPT = 10  # neighbours of a vector in the graph
LEAF = 4096  # vectors of a cell, about; a block has at most four times as many
TREES, TREES_AT_ONCE = 8, 4
BEAM = 100  # points that a search holds
ROUNDS = 1  # of joins of neighbours of neighbours, at least
SETTLED = 0.02  # share of edges changed in a round at which rounds end
HOT = 128  # vectors naming one that meet at it in one block, about
MEETINGS = 4  # parts of a round over a large collection, one after the other, so that its shuffle files stay small
SAMPLE = 40_000  # vectors that landmarks are drawn from and cells measured by, about at most
LANDMARKS = 256  # of a level of cells, at most
DEEPER, DEEPEST = 16, 8  # directions that part a cell too large, and levels of them
BROADCAST_ROWS = 200_000  # rows of 12 bytes that are sent to all tasks, at most; more are joined by shuffle
CLOSE = 0.95  # cosine of a close pair
_SLACK = 0.01  # by which codes may understate a cosine
_WIDTH = 13 * KEPT  # bytes of a row's neighbours: ids, cosines and whether they are fresh
_STATE = "id long, code binary, near binary, worst float, fresh int"


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """The values of a binary column that have `width` bytes, as rows; others are empty or null."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, width) if data is not None else np.zeros((0, width), np.uint8)


def _binary(rows: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as a binary column; where present is given, other places are empty."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.uint8)
    size = np.full(len(rows), data.shape[1]) if present is None else np.where(present, data.shape[1], 0)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def _width(column: pa.Array) -> int:
    """Bytes of the values of a binary column that aren't empty; all have as many."""
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, int)
    return int(size.max()) if len(size) and size.max() else DIMENSIONS


def _codes(column: pa.Array) -> np.ndarray:
    return _fixed(column, _width(column)).view(np.int8)


def _floats(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of codes; sums of whole numbers, so they don't depend on the order of adding."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    dot, aa, bb = (np.einsum("ij,ij->i", p, q).astype(np.float64) for p, q in ((a, b), (a, a), (b, b)))
    return (dot / np.sqrt(np.maximum(aa * bb, 1e-9))).astype(np.float32)


def encoded(vectors: DataFrame, width: int = DIMENSIONS) -> DataFrame:
    """key, code of (key, embedding), one row per key: usable embeddings only, that is of `width`
    finite values that aren't all zero. Null keys drop out; of differing copies the largest code stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            fit = np.asarray(pa.compute.equal(pa.compute.list_value_length(lists), width).fill_null(False))
            keys, lists = keys.filter(pa.array(fit)), lists.filter(pa.array(fit))
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, width)
            with np.errstate(all="ignore"):
                top = np.abs(x).max(1) if len(x) else np.zeros(0)
                good = np.isfinite(x).all(1) & (top > 0)
                x = x[good] / top[good, None]
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(good)), _binary(np.rint(x * 127).astype(np.int8))], names=["key", "code"])

    rows = vectors.filter("key IS NOT NULL AND embedding IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, "key string, code binary").groupBy("key").agg(F.max("code").alias("code"))


def _mixed(*numbers) -> np.ndarray:
    """A number of 64 bits from arrays of them, well mixed."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for n in numbers:
            h = (h ^ np.asarray(n).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(29))
    return h


class Cells:
    """Partitions of space, one per tree. A vector's cell is the landmark nearest to it, where there are
    too many vectors for LANDMARKS cells followed by the direction that the rest of it points to, and so
    on. Cells that hold several blocks' vectors by the sample are parted by further directions; what
    nothing parts, such as copies of one vector, by a hash that differs from tree to tree.

    The sample bounds all of it, whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, n: int, leaf: int, trees: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        want, self.levels = max(8, -(-n // leaf)), []
        while want > 1 and len(self.levels) < 6:
            self.levels.append(min(LANDMARKS, want))
            want = -(-want // LANDMARKS)
        unit = lambda x: (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.marks, self.apart = [], []
        for _ in range(trees):
            marks = sample[rng.choice(len(sample), min(self.levels[0], len(sample)), replace=False)]
            if len(marks) < self.levels[0]:
                marks = np.vstack([marks, rng.normal(size=(self.levels[0] - len(marks), sample.shape[1]))])
            first = unit(marks)
            later = []
            for k in [*self.levels[1:], *[DEEPER] * DEEPEST]:
                a, b = (sample[rng.integers(len(sample), size=k)] for _ in "ab")
                later.append(unit(a - b + 1e-3 * rng.normal(size=a.shape)))
            self.marks.append([first, *later])
            self.apart.append(({}, {}))
        share = n / max(len(sample), 1)
        for tree in range(trees):
            deep, salted = self.apart[tree]
            rest = self._base(sample, tree)
            for level in range(len(self.levels), len(self.levels) + DEEPEST + 1):
                cell, where, count = np.unique(rest[0], return_inverse=True, return_counts=True)
                large = (count * share > 4 * leaf) & (count >= 8)
                if level == len(self.levels) + DEEPEST:
                    salted.update({int(c): int(-(-m * share // leaf)) for c, m in zip(cell[large], count[large], strict=True)})
                    break
                deep.update(dict.fromkeys(map(int, cell[large]), level))
                kept = large[where]
                if not kept.any():
                    break
                rest = self._step(rest[0][kept], rest[1][kept], tree, level)

    def _base(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        cell, rest = np.full(len(x), tree, np.uint64), x
        for level in range(len(self.levels)):
            cell, rest = self._step(cell, rest, tree, level)
        return cell, rest

    def _step(self, cell: np.ndarray, rest: np.ndarray, tree: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        marks = self.marks[tree][level]
        value = rest @ marks.T
        best = value.argmax(1)
        return _mixed(cell, best), rest - np.take_along_axis(value, best[:, None], 1) * marks[best]

    def cells(self, x: np.ndarray, ids: np.ndarray, tree: int) -> np.ndarray:
        cell, rest = self._base(x, tree)
        deep, salted = self.apart[tree]
        for level in range(len(self.levels), len(self.levels) + DEEPEST):
            parted = np.array([c for c, at in deep.items() if at == level], np.uint64)
            at = np.flatnonzero(np.isin(cell, parted)) if len(parted) else []
            if not len(at):
                break
            cell[at], rest[at] = self._step(cell[at], rest[at], tree, level)
        for c, parts in salted.items():
            at = np.flatnonzero(cell == np.uint64(c))
            cell[at] = _mixed(cell[at], _mixed(ids[at], tree) % np.uint64(parts))
        return cell.view(np.int64)


def _packed(group: np.ndarray, n: int, owner: np.ndarray, other: np.ndarray, sim: np.ndarray, fresh: np.ndarray, repeats: bool) -> np.ndarray:
    """A row of bytes for each of n groups: the KEPT best distinct others of the candidates that `group`
    numbers, best first; of equal cosines a hash of both ids decides, so that copies name different ones.
    owner: ids of the candidates' groups. A pair is fresh only if all its candidates are; they have one cosine."""
    down = (np.float32(2) - sim.astype(np.float32)).view(np.uint32).astype(np.uint64)  # from 1 on, so bits are in order
    place = (group.astype(np.uint64) << np.uint64(32)) | down
    order = np.argsort(place)
    place = place[order]
    same = place[1:] == place[:-1]
    if same.any():
        tied = np.append(same, False) | np.append(False, same)
        few = order[tied]
        order[tied] = few[np.lexsort((_mixed(owner[few], other[few]), place[tied]))]
    group, other, sim, fresh = group[order], other[order], sim[order], fresh[order]
    if repeats and same.any():
        new = np.append(True, (group[1:] != group[:-1]) | (other[1:] != other[:-1]))
        start = np.flatnonzero(new)
        fresh = np.minimum.reduceat(fresh, start)
        group, other, sim = group[start], other[start], sim[start]
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    fit = rank < KEPT
    ids, sims, flags = np.full((n, KEPT), -1, "<i8"), np.full((n, KEPT), -2, "<f4"), np.zeros((n, KEPT), np.uint8)
    at = group[fit] * KEPT + rank[fit]
    ids.ravel()[at], sims.ravel()[at], flags.ravel()[at] = other[fit], sim[fit], fresh[fit]
    return np.hstack([ids.view(np.uint8).reshape(n, -1), sims.view(np.uint8).reshape(n, -1), flags])


def _unpacked(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, cosines and flags of rows of _packed(), KEPT columns each; ids of -1 are empty places."""
    ids = np.ascontiguousarray(near[:, : 8 * KEPT]).view("<i8")
    sims = np.ascontiguousarray(near[:, 8 * KEPT : 12 * KEPT]).view("<f4")
    return ids, sims, near[:, 12 * KEPT :]


def _empty(n: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.zeros(n + 1, np.int32)), pa.py_buffer(b"")])


def _results(ids: np.ndarray, i: np.ndarray, j: np.ndarray, sim: np.ndarray, repeats: bool = True) -> pa.RecordBatch:
    """Candidates, of row i of ids row j, as rows of _STATE without a code, one per row of ids that has any."""
    has = np.zeros(len(ids), bool)
    has[i] = True
    owner, group = ids[has], (np.cumsum(has) - 1)[i]
    near = _packed(group, len(owner), ids[i], ids[j], sim, np.ones(len(i), np.uint8), repeats)
    n = len(owner)
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), _empty(n), _binary(near), pa.array(np.full(n, -2, np.float32)), pa.array(np.zeros(n, np.int32))], names=["id", "code", "near", "worst", "fresh"])


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int, most: int | None = None) -> Iterator[tuple[np.ndarray, list]]:
    """Runs of rows whose first column repeats are kept together, at least `least` rows at a time; a run that
    by itself has more than `most` rows is cut. Columns after the first as Arrow arrays."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        first = np.asarray(table.column(0))
        stop = int(np.searchsorted(first, first[-1], side="left"))
        if most is not None and n - stop > most:
            stop = n
        if stop:
            yield first[:stop], [c.slice(0, stop) for c in table.columns[1:]]
        held, n = [table.slice(stop)], n - stop
    if n:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield np.asarray(table.column(0)), list(table.columns[1:])


def _merged(state: DataFrame, results: DataFrame | None, met: bool = False) -> DataFrame:
    """state with the candidates of results taken in. met: what state holds isn't fresh any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, (code, near) in _whole_groups(batches, 20_000):
            own = np.diff(np.frombuffer(code.buffers()[1], np.int32)[code.offset : code.offset + len(code) + 1]) > 0
            other, sim, fresh = _unpacked(_fixed(near, _WIDTH))
            if met:
                fresh = np.where(own[:, None], 0, fresh).astype(np.uint8)
            start = np.append(True, ids[1:] != ids[:-1])
            group, there = np.cumsum(start) - 1, other >= 0
            row = np.repeat(np.arange(len(ids)), KEPT).reshape(-1, KEPT)[there]
            best = _packed(group[row], int(start.sum()), ids[row], other[there], sim[there], fresh[there], repeats=True)
            _, sims, flags = _unpacked(best)
            codes = _fixed(code, _width(code))
            yield pa.RecordBatch.from_arrays([pa.array(ids[start]), _binary(codes), _binary(best), pa.array(np.ascontiguousarray(sims[:, -1])), pa.array(flags.sum(1).astype(np.int32))], names=["id", "code", "near", "worst", "fresh"])

    rows = state if results is None else state.unionByName(results)
    return rows.select("id", "code", "near").repartition("id").sortWithinPartitions("id").mapInArrow(run, _STATE)


def _release(spark: SparkSession) -> None:
    """Lets shuffle files of finished steps be deleted now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _places(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few places of a matrix that are true, found by words of eight."""
    width = hits.shape[1]
    flat = hits.ravel()
    full = len(flat) // 8 * 8
    words = flat[:full].view(np.uint64)
    word = np.flatnonzero(words != 0)
    at = np.flatnonzero(words[word].view(bool))
    at = np.concatenate([word[at >> 3] * 8 + (at & 7), np.flatnonzero(flat[full:]) + full])
    row = at // width
    return row, at - row * width


def _near_in_block(codes: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of pairs of a block's vectors of which j may be among the KEPT nearest of i and is
    nearer than worst[i]. Where worst says less, a bound comes from an eighth of the block, whose third
    nearest is the last to be taken in; by it about nine in ten vectors get KEPT candidates or more. Each
    pair is multiplied once: rows go by their bound, the least first, so that a pair which passes either
    bound passes that of the earlier row. Products of codes are whole numbers, as in _cosines()."""
    x = codes.astype(np.float32)
    m, square = len(x), np.einsum("ij,ij->i", x, x).astype(np.float64)
    norm = np.sqrt(square).astype(np.float32)

    def cosines(i: np.ndarray, j: np.ndarray, dot: np.ndarray) -> np.ndarray:
        return (dot.astype(np.float64) / np.sqrt(np.maximum(square[i] * square[j], 1e-9))).astype(np.float32)

    if m <= 512:
        dot = x @ x.T
        sim = dot / (norm[:, None] * norm)
        np.fill_diagonal(sim, -3)
        if m > KEPT:
            worst = np.maximum(worst, np.partition(sim, m - KEPT, axis=1)[:, m - KEPT] - 1e-5)
        i, j = np.nonzero(sim > worst[:, None])
        return i, j, cosines(i, j, dot[i, j])
    part, rows = np.arange(0, m, 8), 256
    few = (x / norm[:, None]) @ (x[part] / norm[part, None]).T
    few[part, np.arange(len(part))] = -3
    worst = worst.copy()
    open_ = np.flatnonzero(np.count_nonzero(few > worst[:, None], axis=1) > 2)
    few = few[open_]
    for _ in range(2):
        few[np.arange(len(open_)), few.argmax(1)] = -3
    if len(open_):
        worst[open_] = few.max(1) - 1e-5
    order = np.argsort(worst, kind="stable")
    x, norm, square, worst = x[order], norm[order], square[order], worst[order]
    least = (worst - np.float32(1e-5)) * norm
    left, right, value = [], [], []
    dots, bounds, passed = np.empty(rows * m, np.float32), np.empty(rows * m, np.float32), np.empty(rows * m, bool)
    for s in range(0, m, rows):
        some, rest = x[s : s + rows], x[s:]
        dot, bound, hits = (a[: len(some) * len(rest)].reshape(len(some), -1) for a in (dots, bounds, passed))
        np.matmul(some, rest.T, out=dot)
        np.multiply(least[s : s + rows, None], norm[s:], out=bound)
        i, j = _places(np.greater(dot, bound, out=hits))
        later = j > i
        i, j = i[later], j[later]
        cosine = cosines(i + s, j + s, dot[i, j])
        i, j = i + s, j + s
        up, down = cosine > worst[i], cosine > worst[j]
        left += [i[up], j[down]]
        right += [j[up], i[down]]
        value += [cosine[up], cosine[down]]
    return order[np.concatenate(left)], order[np.concatenate(right)], np.concatenate(value)


def _in_cells(state: DataFrame, cells: Cells, trees: list[int], leaf: int, n: int) -> DataFrame:
    """Rows of the neighbours that each vector has in its cells of some trees, nearer than those it has."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _floats(_codes(batch.column(1))), np.asarray(batch.column(0))
            for tree in trees:
                order = _mixed(ids, tree).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells.cells(x, ids, tree)), pa.array(order), *batch.columns], names=["cell", "place", "id", "code", "worst"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, (_, ids, codes, worst) in _whole_groups(batches, 1, 4 * leaf):
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            own, code, least = np.asarray(ids), _codes(codes), np.asarray(worst)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    yield _results(own[a:b], *_near_in_block(code[a:b], least[a:b]), repeats=False)

    placed = state.select("id", "code", "worst").mapInArrow(assign, "cell long, place long, id long, code binary, worst float")
    tasks = max(12, len(trees) * n // 60_000)
    return placed.repartition(tasks, "cell").sortWithinPartitions("cell", "place").mapInArrow(compare, _STATE)


def _edges(state: DataFrame, back: bool, coded: bool = False, part: int = 0, parts: int = 1) -> DataFrame:
    """Rows (via, id, fresh) of a part of the vectors that name others, each with those that it names; if
    back, of a part of those named, each with those that name it, and with their code and worst if coded.
    Ids are hashes, so parts follow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            other, _, fresh = _unpacked(_fixed(batch.column(1), _WIDTH))
            fit = (other >= 0) & (other % parts == part) if back else other >= 0
            row = np.repeat(np.arange(len(ids)), KEPT).reshape(-1, KEPT)[fit]
            owner, other, fresh = ids[row], other[fit], fresh[fit].astype(bool)
            columns = [pa.array(x) for x in ((other, owner, fresh) if back else (owner, other, fresh))]
            if coded:
                columns += [_binary(_codes(batch.column(2))[row]), pa.array(np.asarray(batch.column(3))[row])]
            yield pa.RecordBatch.from_arrays(columns, names=["via", "id", "fresh", "code", "worst"][: len(columns)])

    rows = state if back else state.filter(F.col("id") % parts == part)
    return rows.select("id", "near", *(["code", "worst"] if coded else [])).mapInArrow(run, "via long, id long, fresh boolean" + (", code binary, worst float" if coded else ""))


def _sized(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def _meetings(state: DataFrame) -> tuple[DataFrame, dict]:
    """(via, fresh, blocks) of the vectors at which no edge is fresh, or that more than HOT name; and how
    many there are of both. One pass, for all parts of a round."""
    named = state.select(F.col("id").alias("via"), (F.col("fresh") > 0).alias("fresh"), F.lit(0).alias("n"))
    stats = _edges(state, True).select("via", "fresh", F.lit(1).alias("n")).unionByName(named).groupBy("via").agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh"))
    return cut_counting(
        stats.select("via", "fresh", F.greatest(F.ceil(F.col("n") / HOT), F.lit(1)).cast("int").alias("blocks")).filter("NOT fresh OR blocks > 1"), hot=F.count_if(F.expr("fresh AND blocks > 1")), done=F.count_if(F.expr("NOT fresh"))
    )


def _descend(state: DataFrame, turn: int, part: int = 0, parts: int = 1, meetings: tuple[DataFrame, dict] | None = None) -> DataFrame:
    """Rows of better neighbours: all vectors that a vector names and all that name it meet at it, and
    pairs of which one came by a fresh edge are compared. part: of so many parts of the vectors met at.
    meetings: _meetings(state), if it is there already.

    Where more than HOT name one vector, these are spread over blocks by a hash, drawn anew in each round,
    and the vectors that it names are in every block. So groups are bounded, and whoever names it meets
    all that it names."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, (ids, fresh, codes, worst) in _whole_groups(batches, 40_000):
            ids, fresh, code, worst = np.asarray(ids), np.asarray(fresh).astype(bool), _codes(codes), np.asarray(worst)
            order = np.lexsort((ids, group))
            group, ids = group[order], ids[order]
            once = np.append(True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]))  # those that name each other came twice
            at = np.flatnonzero(once)
            fresh = np.logical_or.reduceat(fresh[order], at)
            group, ids, code, worst = group[at], ids[at], code[order[at]], worst[order[at]]
            x = _floats(code)
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(start, len(group)))
            left, right = [], []
            for m in np.unique(size[size > 1]):
                at = start[size == m][:, None] + np.arange(m)
                for few in np.array_split(at, -(-at.size * int(m) // 500_000)):
                    y, new = x[few], fresh[few]
                    hits = np.matmul(y, y.transpose(0, 2, 1)) > worst[few][:, :, None]
                    if not new.all():
                        hits &= new[:, :, None] | new[:, None, :]
                    hits[:, np.arange(m), np.arange(m)] = False
                    a, b = _places(hits.reshape(-1, m))
                    left.append(few.ravel()[a])
                    right.append(few[a // m, b])
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                yield _results(ids, i, j, _cosines(code[i], code[j]))

    met, seen = meetings or _meetings(state)
    met = met.filter(F.col("via") % parts == part)
    namers = state
    if seen["done"]:
        done = _sized(met.filter("NOT fresh").select("via"), seen["done"] // parts)
        namers = state.join(done, state["id"] == done["via"], "left_anti")
    named, naming = _edges(namers, False, False, part, parts), _edges(state, True, True, part, parts)
    if seen["done"]:
        naming = naming.join(done, "via", "left_anti")
    if seen["hot"]:
        hot = _sized(met.filter("fresh").select("via", "blocks"), seen["hot"] // parts)
        every = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        own = F.coalesce(F.pmod(F.xxhash64(F.lit(turn), "id"), F.col("blocks")).cast("int"), F.lit(0))
        named = named.join(hot, "via", "left").select("via", "id", "fresh", F.explode(every).alias("block"))
        naming = naming.join(hot, "via", "left").select("via", "id", "fresh", "code", "worst", own.alias("block"))
    else:
        named, naming = (rows.withColumn("block", F.lit(0)) for rows in (named, naming))
    members = named.join(state.select("id", "code", "worst"), "id").unionByName(naming)
    members = members.select(F.xxhash64("via", "block").alias("group"), "id", "fresh", "code", "worst")
    return members.repartition("group").sortWithinPartitions("group").mapInArrow(meet, _STATE)


def indexed(vectors: DataFrame, width: int = DIMENSIONS) -> DataFrame:
    """points (id, key, code), written to the shared folder. Ids are a hash of the key, so that nothing
    follows the partitioning; should two keys share one, all are hashed anew with the next salt."""
    rows, salt = encoded(vectors, width), 0
    while True:
        points = spill(rows.select(F.xxhash64(F.lit(salt), "key").bitwiseAND(F.lit(2**63 - 1)).alias("id"), "key", "code"), "points")
        if points.groupBy("id").count().filter("count > 1").isEmpty():
            return points
        rows, salt = points.select("key", "code"), salt + 1


def neighbour_graph(points: DataFrame, trees: int = TREES, rounds: int = ROUNDS, leaf: int = LEAF, settled: float = SETTLED) -> DataFrame:
    """graph (id, near): the KEPT nearest vectors found of each point. A collection of one has no edges.
    rounds: of joins at least; they go on until the share of edges that a round changed is at most settled."""
    spark, n = points.sparkSession, points.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = points.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * share)).select("id", "code")
    codes = [bytes(code) for _, code in sorted((r.id, r.code) for r in sample.toLocalIterator())] or [bytes([1] * DIMENSIONS)]
    cells = Cells(_floats(np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1)), n, leaf, trees)
    nothing = np.hstack([np.full((1, KEPT), -1, "<i8").view(np.uint8), np.full((1, KEPT), -2, "<f4").view(np.uint8), np.zeros((1, KEPT), np.uint8)]).tobytes()
    state = points.select("id", "code", F.lit(bytearray(nothing)).alias("near"), F.lit(-2.0).cast("float").alias("worst"), F.lit(0).alias("fresh"))
    counts = {"fresh": F.sum(F.col("fresh").cast("long")), "n": F.count(F.lit(1))}
    for first in range(0, trees, TREES_AT_ONCE):
        state, seen = cut_counting(_merged(state, _in_cells(state, cells, list(range(first, min(trees, first + TREES_AT_ONCE))), leaf, n)), **counts)
        _release(spark)
    turn = 0
    while seen["fresh"] and (turn < rounds or seen["fresh"] > settled * KEPT * seen["n"]):
        found, parts, meetings = None, min(MEETINGS, 1 + n // 50_000), _meetings(state)
        for part in range(parts):
            better = cut(_descend(state, turn, part, parts, meetings))
            found = better if found is None else found.unionByName(better)
            _release(spark)
        state, seen = cut_counting(_merged(state, found, met=True), **counts)
        _release(spark)
        turn += 1
    return state.select("id", "near")


def graph_edges(graph: DataFrame, least: float = -2) -> DataFrame:
    """(id, other, cosine, rank) of a graph, ranks from 1; of edges with a cosine of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other, sim, _ = _unpacked(_fixed(batch.column(1), _WIDTH))
            there = (other >= 0) & (sim.astype(np.float64) >= least)
            row, rank = np.nonzero(there)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[row]), pa.array(other[there]), pa.array(sim[there].astype(np.float64)), pa.array((rank + 1).astype(np.int32))], names=["id", "other", "cosine", "rank"])

    return graph.select("id", "near").mapInArrow(run, "id long, other long, cosine double, rank int")


def nearest(points: DataFrame, graph: DataFrame) -> DataFrame:
    """key, neighbour, rank, cosine: the nearest of each key by codes; equal cosines rank by id."""
    keys = points.select("id", "key")
    return (
        graph_edges(graph)
        .join(keys, "id")
        .join(keys.select(F.col("id").alias("other"), F.col("key").alias("neighbour")), "other")
        .select("key", "neighbour", "rank", F.round("cosine", 4).alias("cosine"))
    )


def close_pairs(vectors: DataFrame, points: DataFrame, graph: DataFrame, least: float = CLOSE) -> DataFrame:
    """key_a, key_b (the smaller first), cosine: pairs of the graph whose exact cosine is at least `least`."""
    near = graph_edges(graph, least - _SLACK)
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    keys = points.select("id", "key")
    named = (
        pairs.join(keys.select(F.col("id").alias("a"), F.col("key").alias("k1")), "a")
        .join(keys.select(F.col("id").alias("b"), F.col("key").alias("k2")), "b")
        .select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))
    )
    named = cut(named)
    wanted = named.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    full = cut(vectors.join(wanted, "key").groupBy("key").agg(F.max("embedding").cast("array<double>").alias("e")))  # as wide as they were until then
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    both = named.join(full.select(F.col("key").alias("key_a"), F.col("e").alias("x")), "key_a").join(full.select(F.col("key").alias("key_b"), F.col("e").alias("y")), "key_b")
    cosine = dot(F.col("x"), F.col("y")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))
    return both.withColumn("cosine", cosine).filter(F.col("cosine") >= least).select("key_a", "key_b", F.round("cosine", 6).alias("cosine"))


def search_edges(graph: DataFrame, back: int = 2 * KEPT) -> DataFrame:
    """(id, other): the edges of a graph, and back from each vector to the `back` nearest of those that name it, so
    that search reaches vectors that few name. The degree of a vector stays bounded; the limit applies
    within each task before the shuffle."""
    edges = graph_edges(graph)
    order = Window.partitionBy("other").orderBy(F.desc("cosine"), "id")
    named = edges.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= back).select(F.col("other").alias("id"), F.col("id").alias("other"))
    return edges.select("id", "other").unionByName(named).distinct()


def search(points: DataFrame, graph: DataFrame, queries: DataFrame, top: int = KEPT, beam: int = BEAM, steps: int | None = None, entries: int = 64, others: bool = False) -> DataFrame:
    """query, key, rank, cosine: the `top` nearest points of each query (query, code) by greedy search.

    Every query starts at the same `entries` points, drawn by hash. In each step the beam's points that
    came in last are joined with the graph, their neighbours with the points, and the `beam` best stay,
    until no query's beam changes; `steps`, if given, ends it before. others: queries are keys of points,
    which aren't answers to themselves. Queries and points of other widths don't mix. No queries or no
    points give no rows.
    """
    start = points.orderBy(F.xxhash64("key")).limit(entries).select(F.collect_list("id").alias("ids"))
    found = queries.select("query", F.col("code").alias("q")).withColumn("id", F.explode(start.scalar()))
    edges = cut(search_edges(graph))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = np.einsum("ij,ij->i", _floats(_codes(batch.column(1))), _floats(_codes(batch.column(3)))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sim.astype(np.float64))], names=["query", "q", "id", "cosine"])

    kind = queries.schema["query"].dataType.simpleString()

    def scored(rows: DataFrame) -> DataFrame:
        return rows.join(points.select("id", "code"), "id").select("query", "q", "id", "code").mapInArrow(score, f"query {kind}, q binary, id long, cosine double")

    def best(rows: DataFrame, n: int) -> DataFrame:
        ranked = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id)"))
        return ranked.filter(F.col("rank") <= n)

    held = cut(best(scored(found.select("query", "q", "id")).withColumn("open", F.lit(True)), beam).drop("rank"))
    taken = 0
    while steps is None or taken < steps:
        fresh = held.filter("open").select("query", "q", "id").join(edges, "id").select("query", "q", F.col("other").alias("id")).distinct()
        fresh = fresh.join(held.select("query", "id"), ["query", "id"], "left_anti").select("query", "q", "id")
        rows = held.withColumn("open", F.lit(False)).unionByName(scored(fresh).withColumn("open", F.lit(True)))
        held, seen = cut_counting(best(rows, beam).drop("rank"), open=F.count_if("open"))
        if not seen["open"]:
            break
        taken += 1
    named = held.join(points.select("id", "key"), "id")
    if others:
        named = named.filter(F.col("key") != F.col("query").cast("string"))
    return best(named, top).select("query", "key", "rank", F.round("cosine", 4).alias("cosine"))
