"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one queue over all trees, exact reranking.

Index: trees are fitted on a bounded sample (at most SAMPLE vectors and SAMPLE_BYTES, the first by hash of their id); every row
lies in one leaf of every tree. Leaves hold about LEAF_ROWS rows at any size of the table: where the sample is too small for
that many leaves, each leaf is cut further by planes drawn for its tree, at the leaf's centre.
Search: rows get one component more, which brings them all to the norm of the longest, and queries a zero there, scaled to that
norm: then the nearest rows are those of the largest inner products. For a query, leaves of all trees wait in one priority
queue, nearest first (the squared distances to the hyperplanes crossed on the way), and are opened up to a budget of entries.
Budget: the exact neighbours of CALIBRATION queries among all rows tell how far the queue must be followed to find RECALL of
them. It is a figure of the data: a few leaves where vectors form clusters, a good part of them where they are isotropic.
Rerank: queries and rows meet leaf by leaf, where inner products are computed in double precision. The nearest eighth of a
query's leaves gives the score that its k-th neighbour has at least; the other leaves hand on only what reaches it.

Equal vectors are searched once, by a representative, and its smallest ids stand for them (no query needs more than k + 1).
Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do those whose length
is not the most common one; rows with null ids take no part; repeated rows (equal id and vector) count once; ties go to the
smaller id, also among more ties than are asked for; with fewer candidates than k all are returned; other columns are not
read; an empty table or no query gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefact.llm.common import stored

SAMPLE, SAMPLE_BYTES, TREES, LEAF_ROWS, LEAF_SAMPLE = 16_384, 1 << 26, 8, 512, 16
CALIBRATION, RECALL = 128, 0.95
#: Queries that meet a leaf's rows at a time; the part of a query's leaves (one in EARLY, the nearest) that is searched first.
BLOCK, EARLY = 4096, 8

Node = tuple  # (tree-wide number of the hyperplane, left, right), (number of the leaf,) or (leaf, depth below it, turns taken)


class Forest:
    """Trees over a sample: hyperplanes as one matrix, leaves numbered through; below a leaf, `deeper` cuts by its tree's planes."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = 64, deeper: int = 0, seed: int = 1):
        self.draw = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.weight: list[int] = []  # sample vectors in each leaf
        self.tree: list[int] = []
        self.centres: list[np.ndarray] = []
        self.deeper = deeper
        below = self.draw.standard_normal((trees, deeper, sample.shape[1]))
        self.below = below / np.maximum(np.linalg.norm(below, axis=2, keepdims=True), 1e-300)
        self.roots = [self._split(sample, leaf, t) for t in range(trees)]
        self.matrix = np.array(self.planes).reshape(len(self.planes), sample.shape[1])
        self.offset = np.array(self.cuts)
        self.sample = len(sample)
        del self.draw, self.planes, self.cuts

    def _split(self, x: np.ndarray, leaf: int, tree: int) -> Node:
        if len(x) > leaf:
            for _ in range(4):
                plane = self.draw.standard_normal(x.shape[1])
                plane /= np.linalg.norm(plane)
                side = x @ plane
                cut = float(np.median(side))
                right = side > cut
                if right.any() and not right.all():
                    self.planes.append(plane)
                    self.cuts.append(cut)
                    number = len(self.cuts) - 1
                    return number, self._split(x[~right], leaf, tree), self._split(x[right], leaf, tree)
        self.weight.append(len(x))
        self.tree.append(tree)
        self.centres.append(self.below[tree] @ x.mean(axis=0))
        return (len(self.weight) - 1,)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        side = x @ self.matrix.T > self.offset
        out = np.empty((len(x), len(self.roots)), np.int64)
        centres = np.array(self.centres).reshape(len(self.weight), self.deeper)
        for t, root in enumerate(self.roots):
            todo: list[tuple[Node, np.ndarray]] = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if len(node) == 1:
                    out[rows, t] = node[0]
                elif len(rows):
                    go = side[rows, node[0]]
                    todo += [(node[1], rows[~go]), (node[2], rows[go])]
            for turn, cut in zip((x @ self.below[t].T).T, centres[out[:, t]].T, strict=True):
                out[:, t] = out[:, t] * 2 + (turn > cut)
        return out

    def search(self, x: np.ndarray) -> Iterator[tuple[int, float]]:
        """All leaves for one query, by one queue over all trees: each with the share of the index it holds (of all trees together)."""
        margin, low = self.matrix @ x - self.offset, self.below @ x
        queue: list[tuple[float, int, Node, int]] = [(0.0, t, root, -1) for t, root in enumerate(self.roots)]
        whole, number = self.sample * len(self.roots) * 2.0**self.deeper, len(queue)
        while queue:
            far, _, node, depth = heapq.heappop(queue)
            while depth < 0 and len(node) == 3:
                m = margin[node[0]]
                near, other = (node[2], node[1]) if m > 0 else (node[1], node[2])
                heapq.heappush(queue, (far + m * m, number, other, -1))
                number += 1
                node = near
            leaf, key = node if depth >= 0 else (node[0], node[0])
            for k in range(max(depth, 0), self.deeper):
                m = low[self.tree[leaf], k] - self.centres[leaf][k]
                heapq.heappush(queue, (far + m * m, number, (leaf, key * 2 + (m <= 0)), k + 1))
                number += 1
                key = key * 2 + (m > 0)
            yield key, self.weight[leaf] / whole


def _valid(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(ok)
    size = x.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return x.where(F.size("v") == (size[0]["n"] if size else 0))


def _smallest(rows: DataFrame, most: int) -> DataFrame:
    """rep, members: the smallest ids of each group of equal vectors that has several; large groups are thinned in three steps."""
    x = rows
    for salts in (256, 8, 1):
        part = Window.partitionBy("rep", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).orderBy("vec_id")
        x = x.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= most).drop("nth")
    return x.groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def _extended(x: np.ndarray, unit: float, norm: float) -> np.ndarray:
    """Rows over `unit`, all brought to one norm by a last component."""
    x = x / unit
    return np.hstack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1, keepdims=True), 0))])


def _aimed(q: np.ndarray, norm: float) -> np.ndarray:
    """Queries at that norm, with a zero as last component."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return np.hstack([q * (norm / np.linalg.norm(q, axis=1, keepdims=True)), np.zeros((len(q), 1))])


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Where the `most` best are: by score, ties by the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > most:
        at = np.flatnonzero(scores >= -np.partition(-scores, most - 1)[most - 1])
    return at[np.lexsort((ids[at], -scores[at]))][:most]


def _exact(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, summed alike wherever a pair meets."""
    return (r * q).sum(axis=1)


class Index:
    """The forest, how queries and rows enter it, and the share of its entries that a query opens."""

    def __init__(self, forest: Forest, unit: float, norm: float):
        self.forest, self.unit, self.norm = forest, unit, norm
        self.budget = 0.0

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        return self.forest.leaves(_extended(rows, self.unit, self.norm))

    def opened(self, queries: np.ndarray) -> Iterator[list[int]]:
        for x in _aimed(queries, self.norm):
            found, held = [], 0.0
            for leaf, share in self.forest.search(x):
                if held >= self.budget:
                    break
                found.append(leaf)
                held += share
            yield found


def _neighbours(asked: list[tuple[int, list[float]]], k: int, shared: Broadcast):
    """Each task's k best rows of each calibration query, with the leaves they lie in."""
    names, q = np.array([a for a, _ in asked]), np.array([v for _, v in asked])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, len(shared.value.forest.roots)), np.int64))] * len(q)
        for part in parts:
            for start in range(0, len(part), 2000):
                some = part.iloc[start : start + 2000]
                r, ids = _stack(some["v"]), some["rep"].to_numpy()
                leaves, scores = shared.value.leaves(r), q @ r.T
                for i in range(len(q)):
                    other = ids != names[i]
                    s, n, of = (np.concatenate((a, b[other])) for a, b in zip(held[i], (scores[i], ids, leaves), strict=True))
                    at = _best(s, n, k)
                    held[i] = s[at], n[at], of[at]
        for i, (s, n, of) in enumerate(held):
            yield pd.DataFrame({"query_id": [names[i]] * len(s), "rep": n, "score": s, "leaves": list(of)})

    return run


def _shares(shared: Broadcast):
    """How much of the index a calibration query has opened before it comes to each of its neighbours."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for part in parts:
            for x, leaves in zip(_aimed(_stack(part["v"]), index.norm), part["leaves"], strict=True):
                wanted = [set(map(int, of)) for of in leaves]
                held, shares = 0.0, []
                for leaf, share in index.forest.search(x):
                    hit = [w for w in wanted if leaf in w]
                    shares += [held] * len(hit)
                    wanted = [w for w in wanted if leaf not in w]
                    held += share
                    if not wanted:
                        break
                yield pd.DataFrame({"share": shares})

    return run


def fit(reps: DataFrame, queries: DataFrame, k: int, sample: int = SAMPLE, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL) -> Index | None:
    """The index of reps(rep, v), its budget set by queries(query_id, v); None without rows or queries.

    Through the driver go the sample, at most CALIBRATION queries with k neighbours each, and one share for each of those.
    """
    spark = reps.sparkSession
    total = reps.count()
    asked = [(r["query_id"], r["v"]) for r in queries.orderBy(F.xxhash64(F.lit(7), "query_id"), "query_id").limit(CALIBRATION).collect()]
    if not total or not asked:
        return None
    most = max(2, min(sample, SAMPLE_BYTES // (8 * len(asked[0][1]))))
    picked = [r["v"] for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(most).select("v").collect()]
    unit = reps.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    norm = reps.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.lit(unit)) * (x / F.lit(unit)), F.sqrt))).first()[0]
    leaf = leaf_rows * len(picked) / total
    deeper = max(0, int(np.ceil(np.log2(LEAF_SAMPLE / leaf))))
    index = Index(Forest(_extended(np.array(picked), unit, norm), trees, max(LEAF_SAMPLE, int(leaf)), deeper), unit, norm)
    shared = spark.sparkContext.broadcast(index)
    near = reps.mapInPandas(_neighbours(asked, k, shared), "query_id long, rep long, score double, leaves array<long>")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    near = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).groupBy("query_id").agg(F.collect_list("leaves").alias("leaves"))
    vectors = spark.createDataFrame(asked, "query_id long, v array<double>")
    shares = [r[0] for r in vectors.join(near, "query_id").mapInPandas(_shares(shared), "share double").collect()]
    index.budget = float(np.nextafter(np.quantile(shares, recall, method="higher"), 2)) if shares else 1.0
    return index


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each query row; is_query is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = stored(_valid(vectors).withColumn("key", F.xxhash64("v")), "ann-rows")
    reps = stored(rows.groupBy("key", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "ann-reps")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
    index = fit(reps.select("rep", "v"), queries, k, sample, trees, leaf_rows, recall)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)  # trees, planes and cuts of the bounded sample

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            leaves = shared.value.leaves(_stack(part["v"]))
            at = np.repeat(np.arange(len(part)), leaves.shape[1])
            yield pd.DataFrame({"leaf": leaves.ravel(), "id": part["rep"].to_numpy()[at], "v": part["v"].to_numpy()[at]})

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for start in range(0, len(whole), 500):
                part = whole.iloc[start : start + 500]
                found = list(shared.value.opened(_stack(part["v"])))
                at = np.repeat(np.arange(len(part)), [len(x) for x in found])
                early = np.concatenate([np.arange(len(x)) < max(4, len(x) / EARLY) for x in found])
                yield pd.DataFrame({"leaf": np.concatenate([np.array(x, np.int64) for x in found]), "id": part["query_id"].to_numpy()[at], "v": part["v"].to_numpy()[at], "early": early})

    def rerank(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(left) and len(right):
            r, ids = _stack(left["v"]), left["id"].to_numpy()
            longest = np.linalg.norm(r, axis=1).max()
            for start in range(0, len(right), 1000):
                some = right.iloc[start : start + 1000]
                q, least = _stack(some["v"]), some["least"].to_numpy(np.float64)
                rough = q @ r.T
                # Rounding may part equal scores: what lies within it of the last one is compared exactly.
                off = 1e-12 * np.linalg.norm(q, axis=1) * longest
                last = -np.partition(-rough, k, axis=1)[:, k] if len(r) > k + 1 else np.full(len(q), -np.inf)
                last = np.maximum(last, least) - off
                hit = rough.max(axis=1) >= last
                for i in np.flatnonzero(hit):
                    at = np.flatnonzero(rough[i] >= last[i])
                    exact = _exact(q[i], r[at])
                    best = _best(exact, ids[at], k + 1)  # the query itself may be one of them
                    best = best[exact[best] >= least[i]]
                    parts.append(pd.DataFrame({"query_id": some["id"].iloc[i], "rep": ids[at][best], "score": exact[best]}))
        return pd.concat(parts, ignore_index=True)

    placed = "leaf long, id long, v array<double>"
    probes = stored(queries.repartition(max(8, spark.sparkContext.defaultParallelism), "query_id").mapInPandas(probe, f"{placed}, early boolean"), "ann-probes")
    place_of = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")

    def hits(asked: DataFrame, label: str) -> DataFrame:
        """The best of each leaf for the queries that open it. A leaf that many queries open meets them in blocks; counts are
        written, so that both sides read them as tables of their own."""
        blocks = stored(asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), f"ann-blocks-{label}")
        files = blocks.inputFiles()
        again = spark.read.schema(blocks.schema).parquet(*files) if files else spark.createDataFrame([], blocks.schema)
        entries = reps.select("rep", "v").mapInPandas(place, placed).join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "v")
        asked = asked.join(again, "leaf").select("leaf", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "v", "least")
        found = entries.groupBy("leaf", "block").cogroup(asked.groupBy("leaf", "block")).applyInPandas(rerank, "query_id long, rep long, score double")
        found = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
        return stored(found.withColumn("nth", F.row_number().over(place_of)).where(F.col("nth") <= k + 1), f"ann-hits-{label}")

    # The nearest leaves give each query a score that its neighbours must reach; from the others comes only what does.
    first = hits(probes.where("early").withColumn("least", F.lit(float("-inf"))), "early")
    least = first.where(F.col("nth") == k + 1).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    rest = hits(probes.where("NOT early").join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "rest")
    best = first.drop("nth").unionByName(rest.drop("nth")).groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    best = best.withColumn("nth", F.row_number().over(place_of)).where(F.col("nth") <= k + 1)

    several = rows.join(reps.where("n > 1").select("key", "v", "rep"), ["key", "v"]).select("rep", "vec_id").distinct()
    members = stored(_smallest(several, k + 1), "ann-members")
    out = best.join(members, "rep", "left").select("query_id", "score", F.explode(F.coalesce("members", F.array("rep"))).alias("vec_id")).where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
