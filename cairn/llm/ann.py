"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every row is then put into a leaf. A
query walks the tree through a priority queue, nearest centre first, and so
orders the leaves. How many of them are visited is calibrated: for a bounded
set of queries the true neighbours are found by brute force over all rows, and
visits are widened until enough of those lie in visited leaves, on the mean and
for all but the worst twentieth of the queries; a search goes on until its
leaves hold enough rows, however small they are. Large leaves are searched in blocks. Scores are recomputed in double precision in a fixed
order of summation, so that equal vectors tie exactly.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, small_batches


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is not null, empty or zero and has only finite components, of the commonest length; one row per id."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return rows
    rows = rows.filter(F.size("v") == sizes[0]["dim"])
    if not rows.groupBy("vec_id").count().filter("count > 1").limit(1).isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows


class Tree:
    """Nodes hold a centre and children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, branching: int, leaf_size: int, seed: int = 7) -> None:
        self.rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, branching, leaf_size)

    def _grow(self, rows: np.ndarray, branching: int, leaf_size: int) -> int:
        node = len(self.centres)
        self.centres.append(rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        if len(rows) > leaf_size:
            near = self._kmeans(rows, branching)
            parts = [rows[near == k] for k in range(branching) if (near == k).any()]
            if len(parts) > 1:
                self.children[node] = [self._grow(p, branching, leaf_size) for p in parts]
        if not self.children[node]:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        return node

    def _kmeans(self, rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
        centres = rows[self.rng.choice(len(rows), min(k, len(rows)), replace=False)]
        for _ in range(rounds):
            near = ((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)
            centres = np.stack([rows[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        return near

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at each level."""
        out = np.zeros(len(rows), np.int64)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            kids = self.children[node]
            if not kids:
                out[at] = self.leaf[node]
                continue
            c = np.stack([self.centres[k] for k in kids])
            near = ((c**2).sum(axis=1)[None, :] - 2 * rows[at] @ c.T).argmin(axis=1)
            stack += [(k, at[near == j]) for j, k in enumerate(kids) if (near == j).any()]
        return out

    def order(self, query: np.ndarray, most: int, rows: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first leaves that best-bin-first search visits: `most`, and on until they hold `need` rows (`rows` by leaf)."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < need):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                held += int(rows[self.leaf[node]]) if rows is not None else 0
            for k in kids:
                d = query - self.centres[k]
                heapq.heappush(queue, (float(d @ d), k))
        return out


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=1, keepdims=True)  # no overflow of squares
    m = m / scale
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def best(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of c for each of q (own id left out), exactly scored: (query_id, vec_id, score)."""
    out: tuple[list, list, list] = ([], [], [])
    near = _unit(q) @ _unit(c).T
    near[q_ids[:, None] == c_ids[None, :]] = -np.inf
    norm_c = np.sqrt((c * c).sum(axis=1))
    for i in range(len(q_ids)):
        row = near[i]
        edge = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        at = np.flatnonzero((row >= edge - 1e-9) & np.isfinite(row))
        score = (c[at] * q[i]).sum(axis=1) / (np.sqrt((q[i] * q[i]).sum()) * norm_c[at])
        by = np.lexsort((c_ids[at], -score))[:k]
        out[0].append(np.full(len(by), q_ids[i]))
        out[1].append(c_ids[at][by])
        out[2].append(score[by])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)  # type: ignore[return-value]


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visits_for(when: list[list[int]], worst: float, share: float = 0.95) -> int:
    """Visits after which `share` of the queries have `worst` of their neighbours, by the places of those in the queries' orders."""
    needs = sorted(sorted(w)[max(0, int(np.ceil(worst * len(w) - 1e-9)) - 1)] + 1 for w in when)
    return needs[int(np.ceil(share * len(needs) - 1e-9)) - 1] if needs else 1


PAIRS = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query, k: int = 5, sample_rows: int = 20_000, branching: int = 8, leaf_size: int = 400, calibration: int = 128, recall: float = 0.97, block: int = 4096, worst: float = 0.8) -> DataFrame:
    """The k nearest rows by cosine of each row that `is_query` (a condition on vec_id) selects: query_id, rank, vec_id, score.

    The tree is fitted on at most sample_rows rows and visits are calibrated
    with at most `calibration` queries, to a mean of `recall` and to `worst` for
    19 of 20 of them; all rows are indexed and searched. Ties go to the smaller vec_id. Unusable vectors (see `usable`) take no part;
    with fewer than k candidates all are returned; an empty table gives an
    empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = usable(vectors)
    by_hash = F.xxhash64("vec_id", F.lit(11))
    sample = rows.select("v", by_hash.alias("h")).orderBy("h").limit(sample_rows).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = spark.sparkContext.broadcast(Tree(_unit(_matrix(sample.column("v"))), branching, leaf_size))
    leaves = tree.value.leaves

    def place(batches):
        for b in batches:
            leaf = tree.value.assign(_unit(_matrix(b.column("v"))))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf, pa.int32())], ["vec_id", "v", "leaf"])

    index = materialize(rows.mapInArrow(place, "vec_id long, v array<double>, leaf int"), "ann_index")
    queries = index.filter(is_query).select(F.col("vec_id").alias("query_id"), "v")

    # Calibration: the true neighbours of a few queries, and when their leaves would be visited.
    few = queries.orderBy(F.xxhash64("query_id", F.lit(5))).limit(calibration).toArrow()
    few_ids, few_m = np.asarray(few.column("query_id")), _matrix(few.column("v"))
    if not len(few_ids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fixed = spark.sparkContext.broadcast((few_ids, few_m))

    def brute(batches):
        for b in batches:
            got = best(*fixed.value, np.asarray(b.column("vec_id")), _matrix(b.column("v")), k)
            yield pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)), pa.array(got[2].astype(np.float64))], ["query_id", "vec_id", "score"])

    true = ranked(index.select("vec_id", "v").mapInArrow(brute, PAIRS), k).join(index.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    orders = {int(i): {leaf: n for n, leaf in enumerate(tree.value.order(u, leaves))} for i, u in zip(few_ids, _unit(few_m), strict=True)}
    when = np.array([orders[r["query_id"]][r["leaf"]] for r in true] or [0])
    by_query: dict[int, list[int]] = {}
    for r in true:
        by_query.setdefault(r["query_id"], []).append(orders[r["query_id"]][r["leaf"]])
    visits = visits_for(list(by_query.values()), worst)
    while visits < leaves and (when < visits).mean() < recall:
        visits += 1

    filled = np.zeros(leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row per leaf of the bounded tree
        filled[r["leaf"]] = r["count"]

    def route(batches):
        for b in batches:
            m = _matrix(b.column("v"))
            lists = [tree.value.order(u, visits, filled, k + 1) for u in _unit(m)]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("v"), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "qv", "leaves"])

    # Leaves and the queries that visit them are dealt in blocks of about `block` rows.
    n_cand = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("c_blocks"))
    visiting = queries.mapInArrow(route, "query_id long, qv array<double>, leaves array<int>").select("query_id", "qv", F.explode("leaves").alias("leaf"))
    visiting = materialize(visiting, "ann_visits")
    n_query = visiting.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("q_blocks"))
    blocks = F.broadcast(spark.createDataFrame([tuple(r) for r in n_cand.join(n_query, "leaf").collect()] or [(-1, 1, 1)], "leaf int, c_blocks int, q_blocks int"))  # a row per leaf of the bounded tree
    left = visiting.join(blocks, "leaf").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1))).select("leaf", "qb", "cb", "query_id", "qv")
    right = index.join(blocks, "leaf").withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.col("c_blocks")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).select("leaf", "qb", "cb", "vec_id", "v")

    def search(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        got = best(np.asarray(a.column("query_id")), _matrix(a.column("qv")), np.asarray(b.column("vec_id")), _matrix(b.column("v")), k)
        return pa.table({"query_id": pa.array(got[0].astype(np.int64)), "vec_id": pa.array(got[1].astype(np.int64)), "score": pa.array(got[2].astype(np.float64))})

    keys = ["leaf", "qb", "cb"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, PAIRS)
    return ranked(pairs, k)
