"""Exact top-k inner products by dual-tree cover-tree search.

Vectors are turned into integers, floor(1024 * x).  Queries and every block of data are each
indexed by a cover tree: a node's children are centres chosen farthest-first, so they are at
least as far apart as the radius that covers the node's points, and the first child keeps
its parent's centre.  Pairs of nodes are expanded together; for centres c, e and covering
radii r, s no inner product below them exceeds <c,e> + |c|s + |e|r + rs, and the pair is
dropped when that is below the worst kth score of the query node's group.  Scores at the
leaves are exact integers.

Data stay in their partitions.  Queries lie in the shared folder in files of QUERY_BLOCK and
are read one at a time by each block of data (a worker keeps the trees of the last QUERY_TREES
files), so memory is bounded.  A
first round over a hashed sixteenth of the data gives every query a kth score that is surely
reached; in the second round, over all data, blocks hand on only what reaches it.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do
rows without an id; only vectors of the query's length are its candidates; rows that repeat
a query's id are one query (the least vector) and none of its candidates; other repeated
rows are each a candidate; scores beyond a long are held at its limits; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh_path, open_fs

SCALE = 1024
LEAF, CHILDREN = 128, 16
DATA_BLOCK, QUERY_BLOCK = 16_384, 1_024
#: Query trees that a worker keeps.
QUERY_TREES = 32
_LONG = (-(2**63), 2**63 - 1)


class CoverTree:
    """Nodes over the rows of ``points`` (float64, integer-valued), in level order."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.points = points
        self.centre, self.radius, self.span, self.kids = [], [], [], []
        if not len(points):
            return
        self._add(0, len(points), 0)
        at = 0
        while at < len(self.span):
            self._split(at, leaf)
            at += 1
        self.centre = points[np.asarray(self.centre)]
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.radius = np.asarray(self.radius)
        self.leaf = np.asarray([not k for k in self.kids])

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def _add(self, lo: int, hi: int, centre: int) -> int:
        self.centre.append(centre)
        self.radius.append(float(self._distance(self.order[lo:hi], centre).max()))
        self.span.append((lo, hi))
        self.kids.append([])
        return len(self.span) - 1

    def _split(self, node: int, leaf: int) -> None:
        lo, hi = self.span[node]
        if hi - lo <= leaf or self.radius[node] == 0:
            return
        rows = self.order[lo:hi]
        centres = [self.centre[node]]
        near = self._distance(rows, centres[0])
        owner = np.zeros(len(rows), np.int64)
        while len(centres) < CHILDREN and near.max() > 0:
            centres.append(int(rows[near.argmax()]))
            d = self._distance(rows, centres[-1])
            closer = d < near
            owner[closer] = len(centres) - 1
            near = np.minimum(near, d)
        by_owner = np.argsort(owner, kind="stable")
        self.order[lo:hi] = rows[by_owner]
        ends = np.cumsum(np.bincount(owner, minlength=len(centres)))
        for c, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            if b > a:
                self.kids[node].append(self._add(lo + int(a), lo + int(b), centres[c]))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    as_int = lambda m: np.asarray([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(as_int(q) @ as_int(x).T, *_LONG).astype(np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, q_tree: CoverTree, d_tree: CoverTree) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in ``data`` that reach its floor."""
    if not len(queries) or not len(data):
        return []
    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), ascending
    worst = floor.astype(np.float64).copy()
    spans = q_tree.span
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    done = []
    while len(a):
        top = np.einsum("ij,ij->i", q_tree.centre[a], d_tree.centre[b])
        reach = q_tree.norm[a] * d_tree.radius[b] + d_tree.norm[b] * q_tree.radius[a] + q_tree.radius[a] * d_tree.radius[b]
        bound = top + reach
        bound += 1e-9 * (np.abs(top) + reach) + 1e-3
        group = np.asarray([worst[q_tree.order[slice(*spans[n])]].min() for n in range(len(spans))])
        keep = bound >= group[a]
        a, b, bound = a[keep], b[keep], bound[keep]
        ends = q_tree.leaf[a] & d_tree.leaf[b]
        done += list(zip(bound[ends].tolist(), a[ends].tolist(), b[ends].tolist()))
        a, b = a[~ends], b[~ends]
        # open the side with the larger radius, leaves aside
        first = ~q_tree.leaf[a] & (d_tree.leaf[b] | (q_tree.radius[a] >= d_tree.radius[b]))
        pairs = [(c, y) for x, y in zip(a[first], b[first]) for c in q_tree.kids[x]] + [(x, c) for x, y in zip(a[~first], b[~first]) for c in d_tree.kids[y]]
        a, b = np.asarray(pairs, np.int64).reshape(-1, 2).T
    done.sort(key=lambda t: -t[0])
    for bound, x, y in done:
        rows = q_tree.order[slice(*spans[x])]
        if bound < worst[rows].min():
            continue
        cols = d_tree.order[slice(*d_tree.span[y])]
        score = _scores(queries[rows], data[cols])
        fit = score >= worst[rows][:, None]
        for i in np.flatnonzero(fit.any(axis=1)):
            q = rows[i]
            some = cols[fit[i]]
            ids, own = data_ids[some], score[i, fit[i]]
            other = ids != query_ids[q]
            order = np.lexsort((ids[other], -own[other]))[:k]
            found = best[q] + list(zip((-own[other][order]).tolist(), ids[other][order].tolist()))
            found.sort()
            best[q] = found[:k]
            if len(best[q]) == k:
                worst[q] = max(worst[q], -best[q][-1][0])
    return [(int(query_ids[q]), i, -s) for q, found in enumerate(best) for s, i in found]


def _integers(column: pa.Array) -> list[np.ndarray | None]:
    """floor(SCALE * x) of each vector; None where it takes no part."""
    out = []
    for row in column.to_pylist() if column.null_count or not pa.types.is_floating(column.type.value_type) else map(np.asarray, column.to_numpy(zero_copy_only=False)):
        if row is None or any(x is None for x in row):
            out.append(None)
            continue
        v = np.asarray(row, np.float64)
        out.append(np.floor(v * SCALE) if np.isfinite(v).all() else None)
    return out


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and ``v``, the integer vector as float64 bytes, of the rows that take part."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, v in enumerate(_integers(batch.column(1))):
                if v is not None and batch.column(0)[i].is_valid:
                    ids.append(batch.column(0)[i].as_py())
                    out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, v binary")


def _by_length(ids: list[int], raw: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> (places, ids, points)."""
    groups: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        groups.setdefault(len(r) // 8, []).append(i)
    return {n: (np.asarray(at), np.asarray([ids[i] for i in at], np.int64), np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), n)) for n, at in groups.items()}


@lru_cache(maxsize=QUERY_TREES)
def _query_block(path: str) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, CoverTree]]:
    """(length, ids, points, floors, tree) of a file of queries, kept by the worker for the next
    blocks of data."""
    import pyarrow.parquet as pq

    files, root = open_fs(path)
    table = pq.read_table(root, filesystem=files).to_pydict()
    groups = _by_length(table["vec_id"], table["v"]).items()
    return [(n, ids, points, np.asarray([table["floor"][i] for i in at], np.int64), CoverTree(points, 32)) for n, (at, ids, points) in groups]


def _query_blocks(uri: str):
    from pyarrow import fs

    files, root = open_fs(uri)
    for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            yield from _query_block(f"{uri}/{info.base_name}")


def _round(data: DataFrame, uri: str, k: int) -> DataFrame:
    def block(ids, raw):
        trees = {n: (own, points, CoverTree(points)) for n, (_, own, points) in _by_length(ids, raw).items()}
        for n, q_ids, q_points, floor, q_tree in _query_blocks(uri):
            if n in trees:
                own, points, tree = trees[n]
                rows = search(q_points, q_ids, floor, points, own, k, q_tree, tree)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    def run(batches):
        ids, raw = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            raw += batch.column(1).to_pylist()
            while len(ids) >= DATA_BLOCK:
                yield from block(ids[:DATA_BLOCK], raw[:DATA_BLOCK])
                del ids[:DATA_BLOCK], raw[:DATA_BLOCK]
        if ids:
            yield from block(ids, raw)

    return data.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose vec_id is divisible by
    ``every`` (all, if fewer), ties to the smaller vec_id."""
    spark = vectors.sparkSession
    data = quantised(vectors)
    queries = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = queries.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    asked = fresh_path(spark, "topk-queries")
    queries.withColumn("floor", F.lit(_LONG[0]).cast("long")).repartition(parts).write.parquet(asked)
    schema = "vec_id bigint, v binary, floor bigint"
    stored_queries = spark.read.schema(schema).parquet(asked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    sample = data.where(F.pmod(F.xxhash64("vec_id"), F.lit(16)) == 0)
    kth = _round(sample, asked, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id"), F.col("score").alias("kth"))
    bounded = fresh_path(spark, "topk-queries")
    stored_queries.drop("floor").join(kth, F.col("vec_id") == F.col("query_id"), "left").select(
        "vec_id", "v", F.coalesce("kth", F.lit(_LONG[0]).cast("long")).alias("floor")
    ).repartition(parts).write.parquet(bounded)
    return _round(data, bounded, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
