"""Approximate nearest neighbours by inner product: a forest of random-projection trees and exact reranking.

Vectors get one more component that makes all lengths equal, so the largest inner product is the smallest angle. The
forest is fitted on a bounded sample; every distinct vector is then sent down every tree. A query holds all trees in
one priority queue by margin and opens leaves until they hold enough rows. Leaves are cut in blocks of bounded size, as
are the queries that open them, and each block is reranked as one product of matrices. Equal vectors are one entry.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.session import materialize

TREES = 16
# Distinct vectors the trees are fitted on, at most, and how many of them a leaf holds.
SAMPLE_ROWS = 16_384
LEAF_ROWS = 128
# Part of all trees' rows that a query looks at. Vectors without structure need this much for a recall of 0.95.
SEARCH_SHARE = 0.06
# Rows of all trees that a query looks at, at least: in a small table the share alone is too few.
LEAST_ROWS = 24_000
# Vectors longer than this many times the 99th percentile of lengths are compared with every query.
LONG = 1.05
BLOCK_ROWS = 2_048
K = 20


class Forest:
    """Trees of random directions split at the sample's median; nodes in arrays, children after their parent."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF_ROWS, seed: int = 5):
        r = np.random.default_rng(seed)
        self.trees = [self._grow(sample, r, leaf) for _ in range(trees)]

    @staticmethod
    def _grow(sample: np.ndarray, r: np.random.Generator, leaf: int):
        ways, cuts, kids = [], [], []
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(cuts)
            if parent >= 0:
                kids[parent][side] = me
            kids.append([-1, -1])
            way = r.normal(size=sample.shape[1]) if len(rows) > leaf else np.zeros(sample.shape[1])
            at = sample[rows] @ way
            cut = float(np.median(at)) if len(rows) else 0.0
            left, right = rows[at <= cut], rows[at > cut]
            ways.append(way)
            cuts.append(cut)
            if len(rows) > leaf and len(left) and len(right):
                todo += [(right, me, 1), (left, me, 0)]
        return np.array(ways), np.array(cuts), np.array(kids)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of every row in every tree."""
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, (ways, cuts, kids) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(kids[at, 0] >= 0)
                if len(inner) == 0:
                    break
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], ways[node]) > cuts[node]
                at[inner] = kids[node, side.astype(np.int64)]
            out[:, t] = at
        return out

    def search(self, q: np.ndarray, sizes: dict[tuple[int, int], int], enough: int) -> list[tuple[int, int]]:
        """Leaves by margin over all trees until they hold `enough` rows."""
        queue = [(-np.inf, t, 0) for t in range(len(self.trees))]
        heapq.heapify(queue)
        found, rows = [], 0
        while queue and rows < enough:
            margin, t, node = heapq.heappop(queue)
            ways, cuts, kids = self.trees[t]
            while kids[node, 0] >= 0:
                gap = float(q @ ways[node] - cuts[node]) / float(np.linalg.norm(ways[node]))
                near = int(gap > 0)
                # The worst margin on the way down ranks what was left aside.
                heapq.heappush(queue, (max(margin, abs(gap)), t, int(kids[node, 1 - near])))
                node = int(kids[node, near])
            n = sizes.get((t, node), 0)
            if n:
                found.append((t, node))
                rows += n
        return found


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): ids and vectors as doubles, of the most frequent length; the rest takes no part."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    fine = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    length = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fine.filter(F.size("v") == (length[0] if length else 0))


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K, trees: int = TREES, share: float = SEARCH_SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`query_id`, `rank` from 1, `vec_id`, `score`: the k nearest found of every query, ties to the smaller id.

    Queries are rows whose id is divisible by `every`, candidates all rows of another id. Null ids, null or zero vectors,
    ones with a null or non-finite component and ones of an unusual length take no part. Rows alike in id and vector are
    one. With fewer candidates than k, all come. No usable row: no rows.
    """
    spark = df.sparkSession
    usable = _usable(df, id_col, vec_col)
    packed = materialize(usable.groupBy("id", "v").agg(F.xxhash64(F.lit(1), F.first("v")).alias("h"), F.xxhash64(F.lit(2), F.first("v")).alias("h2"), F.sqrt(F.aggregate(F.first("v"), F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))
    entries = materialize(packed.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.min_by("v", "id").alias("v"), F.max("norm").alias("norm")).drop("h2"))
    usual = entries.agg(F.percentile_approx("norm", 0.99, 1000)).first()[0]
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Made as long as the longest, all others would look alike; so the few that are far longer don't set the length.
    top = usual * LONG
    sample = np.array([r["v"] for r in entries.orderBy(F.xxhash64("rep"), "rep").select("v").limit(sample_rows).collect()])

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1, keepdims=True), 0))])

    forest = spark.sparkContext.broadcast(Forest(lifted(sample), trees))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("v").to_pylist())
            if len(x):
                long_ = b.column("norm").to_numpy() > top
                raw, rep = pa.array([v.tobytes() for v in x], pa.binary()), b.column("rep")
                at = forest.value.leaves(lifted(x[~long_]))
                some = lambda mask, tree, leaf: pa.RecordBatch.from_arrays([pa.array(np.full(mask.sum(), tree, np.int32)), pa.array(leaf), rep.filter(pa.array(mask)), raw.filter(pa.array(mask))], ["tree", "leaf", "rep", "x"])
                for t in range(at.shape[1]):
                    yield some(~long_, t, at[:, t])
                # Far longer vectors are a leaf of their own, which every query opens.
                yield some(long_, trees, np.zeros(long_.sum(), np.int64))

    leaves = materialize(entries.select("rep", "v", "norm").mapInArrow(index, "tree int, leaf long, rep long, x binary"))
    # As many rows as the forest has leaves.
    sizes = {(r["tree"], r["leaf"]): r["n"] for r in leaves.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = spark.sparkContext.broadcast(sizes)
    enough = max(k + 1, int(share * sum(sizes.values())), LEAST_ROWS)
    asking = packed.filter(F.col("id") % every == 0).select("h", "h2").distinct()
    reps = packed.join(asking, ["h", "h2"], "left_semi").groupBy("h", "h2").agg(F.min("id").alias("rep"))
    queries = entries.join(reps.select("rep"), "rep", "left_semi").select("rep", "v")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("v").to_pylist())
            for rep, v in zip(b.column("rep").to_pylist(), x):
                q = np.append(v, 0.0)
                found = forest.value.search(q, known.value, enough) + [leaf for leaf in [(trees, 0)] if leaf in known.value]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([t for t, _ in found], np.int32)), pa.array(np.array([f for _, f in found], np.int64)), pa.array(np.full(n, rep)), pa.array([v.tobytes()] * n, pa.binary())],
                    ["tree", "leaf", "rep", "x"],
                )

    visits = materialize(queries.mapInArrow(visit, "tree int, leaf long, rep long, x binary"))
    # Both sides of a leaf are cut in blocks, and every pair of blocks is one group.
    asked = visits.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    held = leaves.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("m"))
    shape = asked.join(held, ["tree", "leaf"]).select("tree", "leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("across"), F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("down"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = leaves.join(shape, ["tree", "leaf"]).withColumn("i", own("down")).select("tree", "leaf", "i", spread("across").alias("j"), F.lit(False).alias("asks"), "rep", "x")
    left = visits.join(shape, ["tree", "leaf"]).withColumn("j", own("across")).select("tree", "leaf", spread("down").alias("i"), "j", F.lit(True).alias("asks"), "rep", "x")

    def rerank(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asks"].to_numpy(bool)
        if not asks.any() or asks.all():
            return pd.DataFrame({"q": [], "rep": [], "score": []}).astype({"q": "int64", "rep": "int64"})
        mat = lambda rows: np.array([np.frombuffer(v, np.float64) for v in rows])
        a, b = mat(block["x"][asks]), mat(block["x"][~asks])
        qs, ids = block["rep"].to_numpy()[asks], block["rep"].to_numpy()[~asks]
        by_id = np.argsort(ids, kind="stable")
        b, ids = b[by_id], ids[by_id]
        n = min(k + 1, len(ids))
        out = []
        for lo in range(0, len(a), 256):
            s = a[lo : lo + 256] @ b.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :n]
            out.append(pd.DataFrame({"q": np.repeat(qs[lo : lo + 256], n), "rep": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out)

    near = left.unionByName(right).groupBy("tree", "leaf", "i", "j").applyInPandas(rerank, "q long, rep long, score double")
    best = near.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).filter(F.col("r") <= k + 1)
    # Of equal vectors at most the k + 1 smallest ids can be in an answer.
    ids = packed.withColumn("r", F.row_number().over(Window.partitionBy("h", "h2").orderBy("id"))).filter(F.col("r") <= k + 1)
    ids = ids.withColumn("rep", F.min("id").over(Window.partitionBy("h", "h2"))).select("rep", "id").distinct()
    every_one = best.join(ids, "rep").select("q", "id", "score").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    answer = every_one.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    same = packed.join(packed.groupBy("h", "h2").agg(F.min("id").alias("q")), ["h", "h2"]).filter(F.col("id") % every == 0).select("q", F.col("id").alias("query_id")).distinct()
    listed = same.join(answer, "q").select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("at", "f"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
