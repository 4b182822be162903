"""Hard negatives: rows of another label that score just below an anchor's positives, by integer inner products.

Angular triangle filtering: every row stores its angles to REFERENCES directions. The angle of anchor and row lies between the
differences and the sums of their stored angles, so its cosine times both norms bounds the score from both sides (widened beyond
all rounding). Rows lie in order of label, nearest direction and angle to it, in blocks; blocks have strips of STRIP rows, and
range partitions are groups. An anchor asks for windows of scores: the best of its label, then for each positive the band below
it. A group, block or strip is entered only where its bounds overlap a window, and only there integer products are taken.
The most promising groups are searched first; the scores found there raise the lower ends of the windows for the others.

Rows are moved once, anchors once for each group (and part of 32 blocks) that they enter, in blocks of at most ANCHORS: a part
is held in memory and anchors stream past it, so nothing grows with the input but the number of tasks. The driver sees a
bounded sample, from which the directions are chosen, and the bounds of at most GROUPS groups.

Defined cases: rows with a null label, a null vector, or any null or non-finite component take no part, nor do rows without
vec_id; repeated rows (equal id, label and vector) are one row; rows of one id with other labels or vectors are rows of their
own; vectors of different lengths are compared as if the shorter ended in zeros; zero and empty vectors score 0; components of
2^46 or more, whose products may not fit 64 bits, are an error; other columns are not read; an empty table, or one without
anchors, positives or negatives, gives an empty result. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefact.llm.common import stored

REFERENCES, SAMPLE, GROUPS, GROUP_ROWS = 16, 4096, 4096, 4096
BLOCK, STRIP, PART, ANCHORS = 512, 32, 32, 256
#: Beyond any score.
FAR = 1 << 62

_TABLE = "kind int, group int, part int, block long, ids binary, labels binary, vectors binary, width int, angles binary, norms binary"
_SENT = "group int, part int, tag int, block long, ids binary, labels binary, vectors binary, width int, angles binary, norms binary, windows binary"
_FOUND = "block long, a long, w long, anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _pack(x: np.ndarray) -> bytes:
    """Integers in as few bytes as hold them; the first byte tells how many."""
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind[2].encode() + np.ascontiguousarray(x).astype(kind).tobytes()


def _unpack(raw: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1).astype(np.float64).reshape(n, width)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.hstack([x, np.zeros((len(x), width - x.shape[1]))])


def _angles(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles to the directions; for zero vectors, whose scores are 0 anyway, a right angle."""
    width = max(x.shape[1], directions.shape[1])
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    cosines = _padded(x, width) @ _padded(directions, width).T / np.where(norms > 0, norms, 1)
    return np.arccos(np.clip(cosines, -1, 1))


def _bounds(angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of anchors (rows) with sets of rows (columns): angles in low..high to each direction, norms in short..long."""
    least, most = np.zeros((len(angles), len(low))), np.full((len(angles), len(low)), np.pi)
    for j in range(angles.shape[1]):
        t = angles[:, j, None]
        np.maximum(least, low[:, j] - t, out=least)
        np.maximum(least, t - high[:, j], out=least)
        near, far = t + low[:, j], t + high[:, j]
        np.minimum(most, np.where(far <= np.pi, far, np.where(near >= np.pi, 2 * np.pi - near, np.pi)), out=most)
    up, down = np.cos(np.maximum(least - 1e-7, 0)), np.cos(np.minimum(most + 1e-7, np.pi))
    n = norms[:, None]
    slack = 1e-6 * n * long + 1
    return np.where(down >= 0, down * short, down * long) * n - slack, np.where(up >= 0, up * long, up * short) * n + slack


def _scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole numbers: sums of products stay below the product of the norms."""
    width = max(a.shape[1], b.shape[1])
    a, b = _padded(a, width), _padded(b, width)
    if bound < 1 << 52:
        return (a @ b.T).astype(np.int64)
    if bound >= FAR:
        raise OverflowError("scores do not fit 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _rows(vectors: DataFrame, label_of: Column | None) -> DataFrame:
    """vec_id, label, q (whole numbers) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    x = x.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite)
    whole = F.transform("v", lambda y: F.when(F.abs(y) < float(1 << 46), F.floor(y * 256)).otherwise(F.raise_error(F.lit("a component is too large for integer scores")).cast("long")))
    x = x.select("vec_id", (label_of if label_of is not None else F.col("label")).cast("long").alias("label"), whole.alias("q"))
    return x.dropDuplicates(["vec_id", "label", "q"])


def _directions(rows: DataFrame) -> np.ndarray:
    """Far apart from each other, from a bounded sample: each next one is the row with the greatest least angle to those before."""
    sample = [np.array(r["q"], np.float64) for r in rows.select("q").orderBy(F.xxhash64("vec_id", "label", "q"), "vec_id", "label", "q").limit(SAMPLE).collect()]
    width = max((len(x) for x in sample), default=1) or 1
    x = np.array([np.pad(y, (0, width - len(y))) for y in sample]).reshape(len(sample), width)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.eye(1, width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(REFERENCES, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _with_angles(directions: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = np.array([_angles(np.array([q], np.float64).reshape(1, -1), directions)[0] for q in batch.column(2).to_pylist()]).reshape(batch.num_rows, len(directions))
            near = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(angles[np.arange(len(near)), near]), pa.array(list(angles), pa.list_(pa.float64()))], names=[*batch.schema.names, "near", "angle", "angles"])

    return run


def _blocks(modulus: int):
    """Sorted rows to blocks (kind 0) of a group, and those that ask to blocks of anchors (kind 1)."""

    def pack(kind: int, group: int, seq: int, rows: list) -> tuple:
        width = max(len(q) for _, _, q, _ in rows)
        x = np.array([[*q, *[0] * (width - len(q))] for _, _, q, _ in rows], np.int64).reshape(len(rows), width)
        norms = np.linalg.norm(x.astype(np.float64), axis=1)
        ids, labels = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8")
        return kind, group, seq // PART, (group << 32) + seq, ids.tobytes(), labels.tobytes(), _pack(x), width, np.array([r[3] for r in rows], "<f8").tobytes(), norms.astype("<f8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {0: [], 1: []}
        seq, group = {0: 0, 1: 0}, 0

        def leave(kind: int) -> pa.RecordBatch:
            row = pack(kind, group, seq[kind], waiting[kind])
            waiting[kind] = []
            seq[kind] += 1
            return pa.RecordBatch.from_pylist([dict(zip(_names(_TABLE), row))], schema=_schema(_TABLE))

        for batch in batches:
            for vec_id, label, q, angles, group in zip(*(batch.column(k).to_pylist() for k in range(5))):
                waiting[0].append((vec_id, label, q, angles))
                if vec_id % modulus == 0:
                    waiting[1].append((vec_id, label, q, angles))
                for kind, most in ((0, BLOCK), (1, ANCHORS)):
                    if len(waiting[kind]) >= most:
                        yield leave(kind)
        for kind in (0, 1):
            if waiting[kind]:
                yield leave(kind)

    return run


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in schema.split(", "))])


class Asked:
    """A block of anchors and the windows they ask for: a (place of the anchor), w, low, high, positive id and score."""

    def __init__(self, row: dict, windows: bytes):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        n = len(self.ids)
        self.x = _unpack(row["vectors"], row["width"], n)
        self.angles, self.norms = np.frombuffer(row["angles"], "<f8").reshape(n, -1), np.frombuffer(row["norms"], "<f8")
        self.windows = np.frombuffer(windows, "<i8").reshape(-1, 6)

    def wanted(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of bounds (anchor, set): whether a window (row) overlaps a set (column)."""
        a = self.windows[:, 0]
        return (high[a] >= self.windows[:, 2, None]) & (low[a] <= self.windows[:, 3, None])


class Groups:
    """The bounds of each group; at most GROUPS."""

    def __init__(self, rows: list, references: int):
        self.number, self.parts = np.array([r["group"] for r in rows]), np.array([r["parts"] for r in rows])
        self.low = np.array([[r[f"low{j}"] for j in range(references)] for r in rows])
        self.high = np.array([[r[f"high{j}"] for j in range(references)] for r in rows])
        self.short, self.long = np.array([r["short"] for r in rows]), np.array([r["long"] for r in rows])
        self.first, self.last = np.array([r["first"] for r in rows]), np.array([r["last"] for r in rows])


def _summary(raw: dict) -> list[tuple[np.ndarray, ...]]:
    """Of a block's angles and norms, lowest and highest for each strip."""
    norms = np.frombuffer(raw["norms"], "<f8")
    angles = np.frombuffer(raw["angles"], "<f8").reshape(len(norms), -1)
    at = np.arange(0, len(norms), STRIP)
    return np.minimum.reduceat(angles, at), np.maximum.reduceat(angles, at), np.minimum.reduceat(norms, at), np.maximum.reduceat(norms, at)


def _group_bounds(references: int):
    names = ["group", "part", "first", "last", "short", "long", *(f"low{j}" for j in range(references)), *(f"high{j}" for j in range(references))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.to_pylist():
                low, high, short, long = _summary(raw)
                labels = np.frombuffer(raw["labels"], "<i8")
                out.append([raw["group"], raw["part"], labels.min(), labels.max(), short.min(), long.max(), *low.min(axis=0), *high.max(axis=0)])
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)), pa.int64()) for c in columns[:4]] + [pa.array(list(map(float, c)), pa.float64()) for c in columns[4:]], names=names)

    return run, ", ".join(f"{n} {'long' if k < 4 else 'double'}" for k, n in enumerate(names))


def _route(shared, same: bool, early: int | None, skip: int):
    """Each block of anchors to the groups it enters: the `early` most promising, or all but the `skip` most promising."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: Groups = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                asked = Asked(row, row["windows"])
                if not len(asked.windows):
                    continue
                low, high = _bounds(asked.angles, asked.norms, groups.low, groups.high, groups.short, groups.long)
                a = asked.windows[:, 0]
                label = asked.labels[a, None]
                fits = (groups.first <= label) & (label <= groups.last) if same else (groups.first != label) | (groups.last != label)
                hope = np.where(fits, high[a], -np.inf).max(axis=0)
                order = np.argsort(-hope, kind="stable")
                if early is None:  # windows may have been raised since the first round, hopes have not
                    enter = np.zeros(len(hope), bool)
                    enter[order[skip:]] = True
                    enter &= (fits & asked.wanted(low, high)).any(axis=0)
                else:
                    enter = np.zeros(len(hope), bool)
                    enter[order[:early]] = True
                    enter &= fits.any(axis=0)
                for g in np.flatnonzero(enter):
                    parts = range(int(groups.parts[g]))
                    yield pa.RecordBatch.from_pylist([{**{n: row[n] for n in ("block", "ids", "labels", "vectors", "width", "angles", "norms", "windows")}, "group": int(groups.number[g]), "part": p, "tag": 1} for p in parts], schema=_schema(_SENT))

    return run


def _meet(same: bool, most: int):
    """Blocks of a part of a group (tag 0), held, and blocks of anchors (tag 1) that stream past: the first `most` of each window."""

    def search(asked: Asked, held: list) -> pa.RecordBatch | None:
        windows = asked.windows
        low_end = windows[:, 2].copy()
        where, score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for raw, (low, high, short, long) in held:
            b_labels = raw["labels_"]
            bounds = _bounds(asked.angles, asked.norms, low, high, short, long)
            asked.windows = np.column_stack([windows[:, :2], low_end, windows[:, 3:]])
            want = asked.wanted(*bounds)
            strips = np.flatnonzero(want.any(axis=0))
            if not len(strips):
                continue
            cols = (strips[:, None] * STRIP + np.arange(STRIP)).ravel()
            cols = cols[cols < len(b_labels)]
            rows = np.unique(windows[want.any(axis=1), 0])
            at = np.full(len(asked.ids), -1)
            at[rows] = np.arange(len(rows))
            s = _scores(asked.x[rows], raw["x"][cols], float(asked.norms[rows].max() * long.max()))
            ok = (asked.labels[rows, None] == b_labels[cols]) == same
            if same:
                for i, j in zip(*np.nonzero(asked.ids[rows, None] == raw["ids_"][cols])):
                    width = max(asked.x.shape[1], raw["x"].shape[1])
                    ok[i, j] &= (_padded(asked.x[rows[i]][None], width) != _padded(raw["x"][cols[j]][None], width)).any()
            w = np.flatnonzero(want.any(axis=1))
            a = at[windows[w, 0]]
            i, j = np.nonzero(ok[a] & (s[a] >= low_end[w, None]) & (s[a] <= windows[w, 3, None]))
            if not len(i):
                continue
            where, score, ids = np.concatenate([where, w[i]]), np.concatenate([score, s[a[i], j]]), np.concatenate([ids, raw["ids_"][cols[j]]])
            order = np.lexsort((ids, -score, where))
            where, score, ids = where[order], score[order], ids[order]
            nth = np.arange(len(where)) - np.searchsorted(where, where)
            keep = nth < most
            full = nth == most - 1
            low_end[where[full]] = score[full]
            where, score, ids = where[keep], score[keep], ids[keep]
        if not len(where):
            return None
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (windows[where, 0], windows[where, 1], asked.ids[windows[where, 0]], windows[where, 4], windows[where, 5], ids, score)], names=_names(_FOUND)[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for raw in batch.to_pylist():
                if (raw["group"], raw["part"]) != here:
                    here, held = (raw["group"], raw["part"]), []
                if raw["tag"] == 0:
                    raw["ids_"], raw["labels_"] = np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["labels"], "<i8")
                    raw["x"] = _unpack(raw["vectors"], raw["width"], len(raw["ids_"]))
                    held.append((raw, _summary(raw)))
                elif (found := search(Asked(raw, raw["windows"]), held)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([raw["block"]] * found.num_rows, pa.int64()), *found.columns], names=_names(_FOUND))

    return run


def _first(found: DataFrame, most: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("block", "a", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= most)


def _raised(most: int):
    """Windows whose lower ends rise to the score of the last of `most` rows found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for windows, found in zip(batch.column("windows").to_pylist(), batch.column("found").to_pylist()):
                x = np.frombuffer(windows, "<i8").reshape(-1, 6).copy()
                place = {(a, w): k for k, (a, w) in enumerate(x[:, :2].tolist())}
                for f in found or []:
                    x[place[f["a"], f["w"]], 2] = f["score"]
                out.append(x.astype("<i8").tobytes())
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n not in ("windows", "found")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[n for n in batch.schema.names if n not in ("windows", "found")] + ["windows"])

    return run


def _search(anchors: DataFrame, blocks: DataFrame, shared, same: bool, most: int, early: int = 2) -> DataFrame:
    """The first `most` rows of each window: _FOUND with rank."""
    plain = anchors.drop("windows")
    held = blocks.select("group", "part", F.lit(0).alias("tag"), "block", "ids", "labels", "vectors", "width", "angles", "norms", F.lit(None).cast("binary").alias("windows"))

    def meet(asking: DataFrame, first: int | None) -> DataFrame:
        sent = asking.mapInArrow(_route(shared, same, first, early), _SENT)
        met = held.unionByName(sent).repartition("group", "part").sortWithinPartitions("group", "part", "tag", "block")
        return met.mapInArrow(_meet(same, most), _FOUND)

    found = stored(_first(meet(anchors, early), most), "negatives-first")
    full = found.where(F.col("rank") == most).groupBy("block").agg(F.collect_list(F.struct("a", "w", "score")).alias("found"))  # of ANCHORS anchors
    again = plain.join(anchors.select("block", "windows"), "block").join(full, "block", "left").select(*plain.columns, "windows", "found")
    rest = meet(again.mapInArrow(_raised(most), ", ".join([x for x in _TABLE.split(", ")] + ["windows binary"])), None)
    return _first(found.drop("rank").unionByName(rest), most)


def _windows(least: int, highest: int):
    """For each block of anchors, a window for each positive: scores from least to highest percent of the positive's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column("found").to_pylist():
                x = [(f["a"], f["rank"], -(-least * f["score"] // 100), highest * f["score"] // 100, f["vec_id"], f["score"]) for f in found]
                out.append(np.array([y for y in x if y[2] <= y[3]], "<i8").tobytes())
            keep = [n for n in batch.schema.names if n != "found"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(out, pa.binary())], names=[*keep, "windows"])

    return run


def hard_negatives(vectors: DataFrame, label_of: Column | None = None, modulus: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, highest: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `modulus`; a positive's negatives score from `least` to `highest` percent of
    its score. `label_of` is a column over vec_id and label (long) that gives the label to use.
    """
    spark = vectors.sparkSession
    rows = stored(_rows(vectors, label_of), "negatives-rows")
    directions = _directions(rows)
    n = rows.count()
    groups = min(max(-(-n // GROUP_ROWS), 1), GROUPS)
    ready = rows.mapInArrow(_with_angles(directions), "vec_id long, label long, q array<long>, near int, angle double, angles array<double>")
    ready = ready.repartitionByRange(groups, "label", "near", "angle", "vec_id").sortWithinPartitions("label", "near", "angle", "vec_id")
    table = stored(ready.select("vec_id", "label", "q", "angles", F.spark_partition_id().alias("group")).mapInArrow(_blocks(modulus), _TABLE), "negatives-blocks")
    blocks, anchors = table.where("kind = 0").drop("kind"), table.where("kind = 1")

    run, schema = _group_bounds(len(directions))
    each = blocks.mapInArrow(run, schema)
    sides = [f(c).alias(c) for f, names in ((F.min, ["first", "short", *(f"low{j}" for j in range(len(directions)))]), (F.max, ["last", "long", *(f"high{j}" for j in range(len(directions)))])) for c in names]
    summary = each.groupBy("group").agg((F.max("part") + 1).alias("parts"), *sides).orderBy("group").collect()  # at most GROUPS rows
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not summary:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(Groups(summary, len(directions)))

    asking = anchors.mapInArrow(_every, ", ".join([*_TABLE.split(", "), "windows binary"]))
    best = stored(_search(asking, blocks, shared, True, positives), "negatives-positives")
    lists = best.groupBy("block").agg(F.collect_list(F.struct("a", "rank", "vec_id", "score")).alias("found"))  # of ANCHORS anchors
    below = anchors.join(lists, "block").select(*anchors.columns, "found").mapInArrow(_windows(least, highest), ", ".join([*_TABLE.split(", "), "windows binary"]))
    found = _search(below, blocks, shared, False, negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One window for each anchor, of all scores."""
    for batch in batches:
        out = [np.array([(a, 0, -FAR, FAR, 0, 0) for a in range(len(ids) // 8)], "<i8").tobytes() for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "windows"])
