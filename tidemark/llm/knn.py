"""The k most similar vectors of every vector (problem 3).

Method: inverted file with product-quantised residuals.  Coarse centroids and residual codebooks are
fitted on a bounded sample; every vector is filed under its nearest centroid with the code of its
residual, and is a query to its ``probes`` nearest lists.  In a list, asymmetric distance tables
(query against codebook) rank the members; the best ``rerank`` are compared by the members' full vectors with the
query in 16-bit fixed point, the same in every list, so that all its similarities carry one rounding (a deviation of max|x| / 113,000 of
its largest part, a twentieth of a 16-bit float's); of all lists the ten best are kept.

Scale: only centroids and codebooks are broadcast (bounded by ``MAX_LISTS`` and the dimension: 16 MB at 64
numbers); their count follows the number of rows, so lists keep their size until ``MAX_LISTS``.  Beyond
``FLAT_LISTS`` the centroids have two levels: cells from the driver's sample, and the lists of each cell trained on the
executors from a sample of that cell; a vector is then compared with the cells and with the lists of its ``CELLS`` nearest
cells, not with all lists.  A list that would be
too large is cut into a grid of member shards and query shards by hashes of the key, whose sizes are
estimated from the sample, so no task holds an unbounded list.  Exact copies of one vector are filed
once; their keys are put back afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_spread
from tidemark.llm.vectors import bounded_sample, kmeans, nearest, unit_rows, usable
from tidemark.session import partitions_for

SAMPLE = 1 << 16
ROWS_PER_LIST = 900
FLAT_LISTS = 2048
MAX_LISTS = 1 << 16
LISTS_PER_CELL = 128
CELLS = 6
SAMPLE_PER_LIST = 48
PROBES = 7
SUBSPACES = 32
RERANK = 200
MEMBERS_PER_SHARD = 4096
QUERIES_PER_SHARD = 16384
#: Rows of one shuffle partition of the lists.
ROWS_PER_TASK = 25_000


@dataclass
class Index:
    """What is broadcast: coarse centroids, residual codebooks, and the shard grid of each list."""

    centres: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x codes x (dim / subspaces)
    member_shards: np.ndarray
    query_shards: np.ndarray
    probes: int
    cells: np.ndarray | None = None  # first level, where there is one
    starts: np.ndarray | None = None  # lists of cell c: starts[c] .. starts[c + 1]

    def code(self, residual: np.ndarray) -> np.ndarray:
        s, _, w = self.books.shape
        return np.stack([nearest(residual[:, j * w : (j + 1) * w], self.books[j]) for j in range(s)], axis=1).astype(np.uint8)

    def closest_lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest lists of each row, nearest first."""
        if self.cells is None:
            return _best(_scores(x, self.centres), None, self.probes)
        near = _best(_scores(x, self.cells), None, CELLS)
        p = self.probes
        score = np.full((len(x), near.shape[1] * p), -np.inf, np.float32)
        number = np.zeros(score.shape, np.int64)
        for slot in range(near.shape[1]):
            order = np.argsort(near[:, slot], kind="stable")
            cell = near[order, slot]
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
            for lo, hi in zip(edges, np.r_[edges[1:], len(cell)]):
                first, last = self.starts[cell[lo]], self.starts[cell[lo] + 1]
                rows = order[lo:hi]
                s = _scores(x[rows], self.centres[first:last])
                top = _best(s, None, p)
                w = top.shape[1]
                score[rows, slot * p : slot * p + w] = np.take_along_axis(s, top, 1)
                number[rows, slot * p : slot * p + w] = top + first
        return _best(score, number, min(p, len(self.centres)))

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.closest_lists(x)[:, 0] if len(x) else np.zeros(0, np.int64)


def _scores(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return x @ centres.T - 0.5 * (centres * centres).sum(1)


def _best(score: np.ndarray, number: np.ndarray | None, k: int) -> np.ndarray:
    """Columns (or their ``number``) of the k best scores of each row, best first."""
    k = min(k, score.shape[1])
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
    return top if number is None else np.take_along_axis(number, top, 1)


def two_levels(src: DataFrame, sample: np.ndarray, rows: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cells, lists, starts)``: cells from the driver's sample, each cell's lists trained where a sample of it is gathered.

    A cell's sample is a hash draw of about ``SAMPLE_PER_LIST * lists`` rows over all cells; a cell that is far
    larger than the others trains on as many lists as any other, its lists are cut into shards later.
    """
    dim = sample.shape[1]
    cells = kmeans(sample, max(2, lists // LISTS_PER_CELL), seed=3)
    shared = src.sparkSession.sparkContext.broadcast(cells)
    grain = 1 << 20
    keep = min(grain, -(-grain * SAMPLE_PER_LIST * lists // rows))
    most = SAMPLE_PER_LIST * LISTS_PER_CELL * 8

    def assign(batches):
        for b in batches:
            x = unit_rows(b.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array(nearest(x, shared.value)), _binary(x)], names=["c", "vec"])

    def train(t: pa.Table) -> pa.Table:
        x = _matrix(t["vec"], np.float32, dim)[:most]
        return pa.table({"c": t["c"][:1], "lists": pa.array([kmeans(x, LISTS_PER_CELL, seed=4).astype(np.float32).tobytes()], pa.binary())})

    drawn = src.where(F.pmod(F.xxhash64("key", F.lit("lists")), F.lit(grain)) < keep).select("e")
    trained = drawn.mapInArrow(assign, "c long, vec binary").groupBy("c").applyInArrow(train, "c long, lists binary")
    own = {r.c: np.frombuffer(r.lists, np.float32).reshape(-1, dim) for r in trained.toLocalIterator()}
    parts = [own.get(c, cells[c : c + 1]) for c in range(len(cells))]
    return cells, np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x)])


def fit(sample: np.ndarray, rows: int, probes: int = PROBES, rows_per_list: int = ROWS_PER_LIST, src: DataFrame | None = None) -> Index:
    """Fit on bounded samples. ``rows`` sets the number of lists and the expected size of each."""
    dim = sample.shape[1]
    lists = int(min(MAX_LISTS, max(1, round(rows / rows_per_list))))
    cells = starts = None
    if src is not None and lists > FLAT_LISTS:
        cells, centres, starts = two_levels(src, sample, rows, lists)
    else:
        centres = kmeans(sample, min(lists, max(1, len(sample) // 8)), seed=1) if len(sample) else np.zeros((1, dim), np.float32)
    ones = np.ones(len(centres), np.int64)
    index = Index(centres, np.zeros((0, 0, 0), np.float32), ones, ones.copy(), probes, cells, starts)
    residual = sample - centres[index.home(sample)]
    width = dim // SUBSPACES
    few = residual[: 1 << 14]
    books = np.zeros((SUBSPACES, 256, width), np.float32)
    for j in range(SUBSPACES):
        b = kmeans(np.ascontiguousarray(few[:, j * width : (j + 1) * width]), 256, rounds=5, seed=2) if len(few) else np.zeros((1, width))
        books[j, : len(b)] = b
        books[j, len(b) :] = b[0] if len(b) else 0
    index.books = books
    if len(sample):
        to = index.closest_lists(sample)
        scale = rows / len(sample)
        index.member_shards = np.maximum(1, np.ceil(np.bincount(to[:, 0], minlength=len(centres)) * scale / MEMBERS_PER_SHARD)).astype(np.int64)
        index.query_shards = np.maximum(1, np.ceil(np.bincount(to.ravel(), minlength=len(centres)) * scale / QUERIES_PER_SHARD)).astype(np.int64)
    return index


_ROUTED = pa.schema([("cell", pa.int64()), ("key", pa.int64()), ("role", pa.int8()), ("vec", pa.binary()), ("code", pa.binary())])


def _route(index: Index, keys: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Rows ``cell, key, role, vec, code``: role 1 member, 2 query, 3 both. A cell is list, member shard, query shard."""
    n = len(keys)
    to = index.closest_lists(x)
    home = to[:, 0]
    code = index.code(x - index.centres[home])
    ms, qs = index.member_shards, index.query_shards
    h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    cell = lambda lst, m, q: (lst.astype(np.int64) << 32) | (m.astype(np.int64) << 16) | q.astype(np.int64)
    single = (ms[home] == 1) & (qs[home] == 1)
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    at = np.flatnonzero(single)
    zero = np.zeros(len(at), np.int64)
    rows.append((cell(home[at], zero, zero), at, 3))
    at = np.flatnonzero(~single)
    own = (h[at] % ms[home[at]].astype(np.uint64)).astype(np.int64)
    for q in range(int(qs[home[at]].max()) if len(at) else 0):
        some = qs[home[at]] > q
        rows.append((cell(home[at][some], own[some], np.full(some.sum(), q)), at[some], 1))
    for p in range(to.shape[1]):
        at = np.arange(n) if p else np.flatnonzero(~single)
        lst = to[at, p]
        mine = ((h[at] >> np.uint64(7)) % qs[lst].astype(np.uint64)).astype(np.int64)
        for m in range(int(ms[lst].max()) if len(at) else 0):
            some = ms[lst] > m
            rows.append((cell(lst[some], np.full(some.sum(), m), mine[some]), at[some], 2))
    cells = np.concatenate([r[0] for r in rows])
    take = np.concatenate([r[1] for r in rows])  # members first, then mere queries
    role = np.concatenate([np.full(len(r[1]), r[2], np.int8) for r in rows])
    # Members travel as float32; a mere query in fixed point.
    member = role != 2
    full, half = np.ascontiguousarray(x[take[member]]), np.concatenate(_fixed(x[take[~member]]), axis=1)
    ends = np.cumsum(np.where(member, x.shape[1] * 4, x.shape[1] * 2 + 4))
    vecs = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(full.tobytes() + half.tobytes())])
    lens = np.where(member, code.shape[1], 0)
    codes = pa.Array.from_buffers(
        pa.binary(), len(take), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(code[take[member]]))]
    )
    return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(keys[take]), pa.array(role), vecs, codes], schema=_ROUTED)


def _fixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in 16-bit fixed point and their scales (float32 as two 16-bit numbers): the greatest number of a row is 32,767."""
    scale = (np.abs(x).max(axis=1, keepdims=True) / 32767).astype(np.float32) if len(x) else np.zeros((0, 1), np.float32)
    return np.rint(x / scale).astype(np.int16), np.ascontiguousarray(scale).view(np.int16)


def _float(fixed: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return fixed.astype(np.float32) * np.ascontiguousarray(scale).view(np.float32)


def _matrix(col: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=dtype).reshape(-1, width)


def _search(index: Index, table: pa.Table, k: int, rerank: int) -> pa.Table:
    """Top ``k`` members of one cell for each of its queries."""
    dim = index.centres.shape[1]
    t = table.combine_chunks()
    role = t["role"].to_numpy()
    keys = t["key"].to_numpy()
    is_member = (role & 1) == 1
    is_query = (role & 2) == 2
    mkeys = keys[is_member]
    mvec = _matrix(t["vec"].filter(pa.array(is_member)), np.float32, dim)
    packed = _matrix(t["vec"].filter(pa.array(~is_member)), np.int16, dim + 2)
    only = _float(packed[:, :dim], packed[:, dim:])
    qkeys = np.r_[keys[is_member & is_query], keys[~is_member]]
    qvec = np.concatenate([_float(*_fixed(mvec[is_query[is_member]])), only])
    schema = pa.schema([("key", pa.int64()), ("near", pa.list_(pa.struct([("sim", pa.float32()), ("id", pa.int64())])))])
    m = len(mkeys)
    if not m or not len(qkeys):
        return schema.empty_table()
    codes = _matrix(t["code"].filter(pa.array(is_member)), np.uint8, SUBSPACES)
    width = dim // SUBSPACES
    top = min(rerank, m)
    keep = min(k + 1, top)
    out_ids, out_sims = [], []
    block = max(16, min(512, (1 << 18) // m))
    for a in range(0, len(qkeys), block):
        q = qvec[a : a + block]
        approx = np.zeros((m, len(q)), np.float32)
        for j in range(SUBSPACES):
            tables = index.books[j] @ q[:, j * width : (j + 1) * width].T  # codes x queries: one asymmetric table a subspace
            approx += tables[codes[:, j]]
        # the centroid's share is the same for all members of the list and does not change their order
        best = np.argpartition(-approx.T, top - 1, axis=1)[:, :top] if top < m else np.broadcast_to(np.arange(m), (len(q), m))
        exact = np.matmul(mvec[best], q[:, :, None])[:, :, 0]
        exact[mkeys[best] == qkeys[a : a + block][:, None]] = -2
        order = np.argpartition(-exact, keep - 1, axis=1)[:, :keep] if keep < top else np.broadcast_to(np.arange(top), (len(q), top))
        out_ids.append(mkeys[np.take_along_axis(best, order, 1)])
        out_sims.append(np.take_along_axis(exact, order, 1))
    ids, sims = np.concatenate(out_ids), np.concatenate(out_sims)
    good = sims.ravel() > -2
    counts = (sims > -2).sum(1)
    near = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(sims.ravel()[good]), pa.array(ids.ravel()[good])], names=["sim", "id"]),
    )
    return pa.Table.from_arrays([pa.array(qkeys), near], schema=schema)


def nearest_neighbours(
    df: DataFrame, key: str = "id", embedding: str = "embedding", dim: int = 64, k: int = 10, probes: int = PROBES, rerank: int = RERANK, rows_per_list: int = ROWS_PER_LIST
) -> DataFrame:
    """``(id long, neighbour long, similarity float)``: up to ``k`` rows for each usable vector, by cosine.

    Unusable vectors (wrong length, null, NaN or infinite parts, all zero) and null keys take no part;
    repeated rows of a key count once; ties may fall either way.
    """
    src = df.select(F.col(key).cast("long").alias("key"), F.col(embedding).alias("e")).where(F.col("key").isNotNull() & usable("e", dim))
    rows = src.count()
    index = df.sparkSession.sparkContext.broadcast(fit(bounded_sample(src, "key", "e", dim, rows, SAMPLE), rows, probes, rows_per_list, src))

    # Copies of one vector: all keys by the smallest one. Only the hashes of repeated vectors survive the filter.
    prints = src.select("key", F.xxhash64("e").alias("h"), F.xxhash64(F.lit("again"), "e").alias("g")).distinct()
    firsts = prints.groupBy("h", "g").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = join_spread(prints, firsts, ["h", "g"], "key").select("key", "first")
    once = src.dropDuplicates(["key"]).join(copies.where("key != first").select("key"), "key", "left_anti")

    def route(batches):
        for b in batches:
            if b.num_rows:
                yield _route(index.value, b.column(0).to_numpy(), unit_rows(b.column(1), dim))

    cells = once.select("key", "e").mapInArrow(route, "cell long, key long, role byte, vec binary, code binary")
    cells = cells.repartition(partitions_for(df.sparkSession, rows * (probes + 1), ROWS_PER_TASK), "cell")
    found = cells.groupBy("cell").applyInArrow(lambda t: _search(index.value, t, k, rerank), "key long, near array<struct<sim: float, id: long>>")
    near = found.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near")), asc=False), 1, k).alias("near"))
    pairs = near.select("key", F.explode("near").alias("x")).select("key", F.col("x.id").alias("other"), F.col("x.sim").alias("sim"))

    if copies.limit(1).count():
        pairs = _with_copies(pairs, copies, k)
    return pairs.select(F.col("key").alias("id"), F.col("other").alias("neighbour"), F.col("sim").alias("similarity"))


def _with_copies(pairs: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Put the copies of filed vectors back, as neighbours and as queries.

    Copies tie, so of a group at most ``k + 1`` members (the smallest keys, by a window with a group
    limit) can be anybody's neighbours; every copy is a query with its group's and its first member's rows.
    """
    w = Window.partitionBy("first").orderBy("key")
    few = copies.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("first").agg(F.collect_list("key").alias("more"))
    other = few.withColumnRenamed("first", "other")
    wide = pairs.join(other, "other", "left").select("key", "sim", F.explode(F.coalesce("more", F.array("other"))).alias("other"))
    repeated = copies.where("key != first").select(F.col("first").alias("key"), F.col("key").alias("copy"))
    again = wide.join(repeated, "key").select(F.col("copy").alias("key"), "other", "sim")
    own = copies.join(few, "first").select("key", F.explode("more").alias("other"), F.lit(1.0).cast("float").alias("sim")).where("other != key")
    best = F.slice(F.sort_array(F.collect_set(F.struct("sim", "other")), asc=False), 1, k)
    every = wide.select("key", "other", "sim").unionByName(again).unionByName(own)
    return every.groupBy("key").agg(best.alias("near")).select("key", F.explode("near").alias("x")).select("key", "x.other", "x.sim")


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: pairs of which at least one names the other as a neighbour."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
