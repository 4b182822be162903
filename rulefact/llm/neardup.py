"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and a check on the full shingle sets.

1. Sketch: each shingle gives every register an exponential value, truncated to ascending intervals so that a shingle visits
   registers in the order of its values and stops once no register can still be improved; a register keeps the level
   floor(1 - log_b(min)) of its minimum. Registers merge by maximum and agree more often the more similar two sets are.
2. Documents with equal shingle sets form one class; only one of them is compared (its node: the smallest doc_id).
3. Bands of registers are hashed to buckets. In the buckets of PIVOT_BANDS bands every member is compared with one pivot (an arbitrary member that
   differs from band to band), so a bucket of n members gives n - 1 pairs, not n * n. Large buckets have a pivot for each
   PIVOT_OF members, and those pivots are compared with the bucket's.
4. Pairs whose joint likelihood estimate is clearly below the threshold are dropped; the rest is confirmed on the full sets
   in whole numbers. Components of the confirmed links follow. A few bands are enough for this step, as the next one is whole.
5. Buckets of all bands whose members ended in several components hold pairs that no pivot has joined. There the members outside the
   bucket's largest component meet all others, block by block, with their registers and full sets. A pair is looked at in the
   first band it shares; a block hands on links between components that it has not joined yet, fewer than it has members,
   and no pairs that are merely likely. So every pair that shares a bucket is in one component, or improbable, or decided by
   its full sets. The comparisons of this step grow with (members outside the largest component) * members of a bucket.

Defined cases: a document without words or text has an empty set and is linked with nothing; one with fewer words than a
shingle has its whole sequence as one shingle; rows with equal doc_id are one document if their sets are equal and are otherwise
one node with several sets; a null doc_id takes no part (component_id null, kept true); very long texts are read whole, a
few MB of text at a time; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.llm.common import Texts, free_name, mix, shingle_sets, slices, stored
from rulefact.llm.graph import components

#: Registers (a prime, so that steps through them form permutations), base and rate of the levels, bands and rows a band.
REGISTERS, BASE, RATE, BANDS, ROWS = 163, 1.001, 20.0, 32, 5
LEVELS = 65534
#: Pairs this far below the threshold by the estimate (about five standard errors of it) are not confirmed.
MARGIN = 0.16
#: Bands whose members are compared with pivots; members of a bucket that share a pivot.
PIVOT_BANDS, PIVOT_OF = 8, 512
#: Members and shingles of a block in the last step; a document of more shingles is a block alone.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def registers(values: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of sets given as ascending hashes and each set's first index: an array of sets x m.

    In step j a shingle's value lies in the j-th of m intervals of equal probability and goes to the j-th register of its own
    permutation. A set is done when all its registers are below the next interval.
    """
    n = len(first) - 1
    least = np.ones((n, m))
    owner = np.repeat(np.arange(n), np.diff(first))
    h = mix(values + np.uint64(0x5851F42D4C957F2D))
    at = (h % np.uint64(m)).astype(np.int64)
    step = ((h >> np.uint64(32)) % np.uint64(m - 1)).astype(np.int64) + 1
    live = np.arange(len(values))
    for j in range(m):
        u = (j + (mix(h[live] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) / 2.0**53) / m
        np.minimum.at(least.reshape(-1), owner[live] * m + (at[live] + j * step[live]) % m, u)
        todo = least.max(axis=1) > (j + 1) / m
        if not todo.any():
            break
        live = live[todo[owner[live]]]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(np.maximum(-np.log1p(-np.minimum(least, 1 - 1e-16)) / RATE, 1e-300)) / np.log(BASE))
    return np.where(np.diff(first)[:, None] > 0, np.clip(level + LEVELS // 2, 0, LEVELS), 0).astype(np.uint16)


def band_keys(regs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(regs), bands), np.int64)
    for b in range(bands):
        key = np.full(len(regs), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, b * rows + r].astype(np.uint64))
        out[:, b] = key.view(np.int64)
    return out


def _set_keys(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit key of each set."""
    if not len(values):
        return [b"\0" * 16] * (len(first) - 1)
    sums = []
    for salt in (0x2545F4914F6CDD1D, 0x6C8E9CF570932BD5):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64)))
        sums.append(total[first[1:]] - total[first[:-1]])
    return [a.tobytes() + b.tobytes() for a, b in zip(*sums, strict=True)]


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity that maximises the likelihood of how registers compare, given both cardinalities (golden section)."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u = na / np.maximum(na + nb, 1)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return above * np.log(up) + below * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(28):
        x, y = high - g * (high - low), low + g * (high - low)
        left = likelihood(x) >= likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


_SKETCH = "node long, n_shingles long, set_key binary, regs binary"


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """node, number of distinct shingles, key of the set and registers of every row of docs(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                values, first = shingle_sets(Texts(part), words)
                regs = registers(values, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(np.diff(first)), pa.array(_set_keys(values, first), pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], names=["node", "n_shingles", "set_key", "regs"])

    return docs.select("node", "text").mapInArrow(run, _SKETCH)


def _full_sets(words: int):
    """The hashes of each text's shingles, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                values, first = shingle_sets(Texts(part), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([values[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], names=["node", "shingles"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column(2)))
            n = keys.shape[1]
            band = np.tile(np.arange(n, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(keys.ravel()), *(pa.array(np.repeat(batch.column(k).to_numpy(), n)) for k in (0, 1))], names=["band", "bucket", "node", "n_shingles"])


def _likely(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = estimate(_matrix(batch.column("regs_a")), _matrix(batch.column("regs_b")), batch.column("na").to_numpy(), batch.column("nb").to_numpy()) >= similarity - MARGIN
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def block_links(node: np.ndarray, root: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int, similarity: float) -> list[tuple[int, int]]:
    """Links between the rows `left` and the rows `right` (or among `left`, if right is left) that join two components.

    Pairs whose first shared band is another one are left to it; those whose registers agree too seldom are improbable; the rest
    is decided by the full sets. Joined components are one from then on, so fewer links are found than there are components.
    """
    percent = round(similarity * 100)
    n = np.array([len(s) for s in sets])
    _, label = np.unique(root, return_inverse=True)
    found = []
    least = (similarity - MARGIN - 0.04) * regs.shape[1]
    for k, i in enumerate(left):
        js = left[k + 1 :] if right is left else right
        js = js[(label[js] != label[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
        if not len(js):
            continue
        same = regs[js] == regs[i]
        near = np.count_nonzero(same, axis=1) >= least
        if not near.any():
            continue
        same, js = same[near], js[near]
        js = js[same[:, : BANDS * ROWS].reshape(len(js), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        if not len(js):
            continue
        values = np.concatenate([sets[j] for j in js])
        at = np.searchsorted(sets[i], values)
        at[at == n[i]] = 0
        both = np.add.reduceat((sets[i][at] == values).astype(np.int64), np.concatenate(([0], np.cumsum(n[js])[:-1])))
        for j in js[100 * both >= percent * (n[i] + n[js] - both)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((max(node[i], node[j]), min(node[i], node[j])))
    return found


def _in_blocks(similarity: float):
    """Rows come sorted by bucket and pair of blocks; a pair that goes on in the next batch waits for it."""

    def compare(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, root, block, low, high, band = (rows.column(c).to_numpy() for c in ("node", "root", "block", "low", "high", "band"))
        found = []
        for a, b in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
            part = rows.slice(a, b - a)
            sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
            left = np.flatnonzero(block[a:b] == low[a])
            right = left if low[a] == high[a] else np.flatnonzero(block[a:b] == high[a])
            found += block_links(node[a:b], root[a:b], _matrix(part.column("regs")), sets, left, right, band[a], similarity)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            key = np.stack([part.column(c).to_numpy() for c in ("bucket", "low", "high")], axis=1)
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1))
            if len(starts) > 1:
                yield from compare(part.slice(0, starts[-1]), starts[:-1])
            rest = part.slice(starts[-1])
        if rest is not None:
            yield from compare(rest, np.zeros(1, np.int64))

    return run


def _confirmed(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("text_a"), 1 << 21):
                n = len(part)
                keys = []
                sizes = []
                for column in (part, batch.column("text_b").slice(at, n)):
                    values, first = shingle_sets(Texts(column), words)
                    sizes.append(np.diff(first))
                    keys.append(mix(values ^ mix(np.repeat(np.arange(1, n + 1, dtype=np.uint64), sizes[-1]))))
                shared = np.isin(keys[0], keys[1], kind="sort")
                first = np.concatenate(([0], np.cumsum(sizes[0])))
                both = np.concatenate(([0], np.cumsum(shared)))
                both = both[first[1:]] - both[first[:-1]]
                linked = (both > 0) & (100 * both >= percent * (sizes[0] + sizes[1] - both))
                yield batch.select(["a", "b"]).slice(at, n).filter(pa.array(linked))

    return run


def _merge(df: DataFrame) -> DataFrame:
    """Joined by sorting on both sides whatever the size, so that plans do not change as tables grow."""
    return df.hint("merge")


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    side = lambda x: _merge(nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"regs_{x}")))
    percent = round(similarity * 100)
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").where(fits).mapInArrow(_likely(similarity), "a long, b long"), "likely")


def _links(likely: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    text = lambda x: _merge(texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")))
    full = likely.join(text("a"), "a").join(text("b"), "b")
    return stored(full.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(words, round(similarity * 100)), "a long, b long"), "links")


def _buckets(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of several members with band, bucket, members, node, n_shingles and the pivot each member is compared with; and
    the pairs (node, pivot) of the pivots of large buckets with the bucket's own."""
    buckets = every.select("node", "n_shingles", "regs").mapInArrow(_bands, "band int, bucket long, node long, n_shingles long")
    # A pivot is the member with the least node XOR bucket: another one in every band.
    least = F.min(F.col("node").bitwiseXOR(F.col("bucket"))).bitwiseXOR(F.col("bucket"))
    pivots = buckets.groupBy("bucket").agg(least.alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(buckets.join(_merge(pivots), "bucket"), "buckets").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / PIVOT_OF)))
    large = shared.where(F.col("members") > PIVOT_OF)
    parts = stored(large.groupBy("bucket", "part", F.col("pivot").alias("top")).agg(least.alias("own")), "pivots")
    shared = shared.join(_merge(parts.select("bucket", "part", "own")), ["bucket", "part"], "left").withColumn("pivot", F.coalesce("own", "pivot"))
    return shared.drop("part", "own"), parts.select(F.col("own").alias("node"), F.col("top").alias("pivot"))


def _apart(settled: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, once for each pair of blocks they meet in: bucket, band, low, high
    (the blocks), block (their own), node, root. Of buckets with the same members, only that of the first band is left."""
    print_of = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "node"))
    each = settled.groupBy("bucket", "band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), print_of(1).alias("f"), print_of(2).alias("g"))
    whole = each.groupBy("bucket", "band").agg(F.max(F.struct("n", "root", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.bit_xor("f").alias("f"), F.bit_xor("g").alias("g"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES))
    whole = whole.groupBy("n", "f", "g").agg(F.min(F.struct("band", "bucket", "main", "w")).alias("x")).select(
        "x.bucket", F.col("x.main.root").alias("main"), blocks(F.col("x.main.n"), F.col("x.main.w")).alias("inside"), blocks(F.col("n") - F.col("x.main.n"), F.col("x.w") - F.col("x.main.w")).alias("outside")
    )
    x = settled.join(_merge(whole), "bucket")
    out, h = F.col("root") != F.col("main"), F.xxhash64("node")
    x = x.withColumn("block", F.when(out, F.pmod(h, F.col("outside"))).otherwise(F.col("outside") + F.pmod(h, F.col("inside"))))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outside") - 1 + F.when(out, F.col("inside")).otherwise(0))))
    return x.select("bucket", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root")


def _classes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of docs(node, text): the sketches, and set_key with the component (the smallest node) of each class of equal sets."""
    sketch = stored(sketches(docs, words), "sketch")
    held = sketch.where("n_shingles > 0 AND node IS NOT NULL")
    classes = stored(held.groupBy("set_key").agg(F.min("node").alias("node")), "classes")
    every = held.join(_merge(classes), ["node", "set_key"], "left_semi").dropDuplicates(["node", "set_key"])
    shared, tops = _buckets(every)
    wanted = shared.select("node").distinct()
    nodes = stored(every.join(_merge(wanted), "node", "left_semi"), "nodes")
    # Only texts of nodes that share a bucket are moved.
    texts = stored(docs.where("node IS NOT NULL AND text IS NOT NULL").join(_merge(wanted), "node", "left_semi"), "texts")

    pairs = shared.where(F.col("band") < PIVOT_BANDS).select("node", "pivot").unionByName(tops).where("node <> pivot")
    pairs = pairs.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    roots = components(_links(_likely_pairs(pairs, nodes, similarity), texts, words, similarity))
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))

    # What shares a bucket and is still apart meets in blocks; only links leave them.
    settled = stored(shared.join(_merge(roots), "node", "left").select("bucket", "band", "node", "n_shingles", F.coalesce("root", "node").alias("root")), "settled")
    apart = stored(_apart(settled), "apart")
    open_nodes = apart.select("node").distinct()
    sets = texts.join(_merge(open_nodes), "node", "left_semi").select("node", "text").mapInArrow(_full_sets(words), "node long, shingles binary")
    full = apart.join(_merge(nodes.select("node", "regs")), "node").join(_merge(sets), "node").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    rest = stored(full.mapInArrow(_in_blocks(similarity), "a long, b long").distinct(), "rest-links")
    roots = components(stars.unionByName(rest))
    return sketch, classes.join(_merge(roots), "node", "left").select("set_key", F.coalesce("root", "node").alias("component"))


def _looked_up(sketch: DataFrame, found: DataFrame) -> DataFrame:
    """node, n_shingles and component (its own node without words) of every row."""
    rows = sketch.select("node", "n_shingles", "set_key").withColumn("lookup", F.when(F.col("n_shingles") > 0, F.col("set_key")))
    return rows.join(_merge(found.withColumnRenamed("set_key", "lookup")), "lookup", "left").select("node", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("node").isNotNull(), F.col("component"))).otherwise(F.col("node")).alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept for every document."""
    out = _looked_up(*_classes(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")), words, similarity))
    return out.select(F.col("node").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("node") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one left of each component (that of the smallest doc_id, null last), with all their columns.

    Every row is compared by itself, so repeated rows, several texts under one doc_id and rows without doc_id count alike;
    documents without words all stay; columns may have any names; an empty table gives an empty result.
    """
    key = free_name(docs, "row_key")
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    slim = keyed.select(F.col(key).alias("node"), F.col("text").cast("string").alias("text"))
    found = _looked_up(*_classes(slim, words, similarity)).join(_merge(keyed.select(F.col(key).alias("node"), F.col("doc_id").cast("long").alias("doc_id"))), "node")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("x")).select(F.col("x.node").alias(key))
    return keyed.join(_merge(kept), key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
