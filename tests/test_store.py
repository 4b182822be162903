"""Stored tables: a change rewrites the buckets it alters and no others; a rerun alters nothing."""

import os

from pyspark.sql import functions as F

from rulefact.operators import changes
from rulefact.sources import store

SCHEMA = "case_id long, k long, v string"


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith(store.BUCKET)}


def test_only_altered_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(c, k, f"v{k}") for c in range(40) for k in range(c * 3, c * 3 + 3)] + [(None, 999, None)]
    store.create(spark.createDataFrame(rows, SCHEMA), path, "case_id", 16)
    before = files(path)
    new = spark.createDataFrame([(5, 15, "changed"), (5, 16, "v16"), (7, 5000, "added"), (9, 27, "v27")], SCHEMA)
    upsert = lambda old, x: changes.upsert(old, x, ["case_id", "k"])
    written = store.change(spark, path, SCHEMA, "case_id", new, upsert, 16)
    want = {(c, k): v for c, k, v in rows} | {(5, 15): "changed", (7, 5000): "added"}
    table = lambda: {(r.case_id, r.k): r.v for r in store.read(spark, path, SCHEMA).collect()}
    assert table() == want and 1 <= len(written) <= 2
    after = files(path)
    assert {d for d in before if after[d] != before[d]} == {f"{store.BUCKET}={b}" for b in written}
    assert store.change(spark, path, SCHEMA, "case_id", new, upsert, 16) == [] and files(path) == after
    gone = spark.createDataFrame([(c, 0, "") for c in range(40)], SCHEMA)
    emptied = store.change(spark, path, SCHEMA, "case_id", gone, lambda old, x: old.join(x.select("case_id"), "case_id", "left_anti").select(*old.columns), 16)
    assert table() == {(None, 999): None} and len(emptied) == len(after) and len(files(path)) == 1
    assert store.change(spark, path, SCHEMA, "case_id", gone.limit(0), upsert, 16) == []


def test_rows_may_not_leave_their_bucket(spark, tmp_path):
    import pytest

    path = str(tmp_path / "t")
    store.create(spark.createDataFrame([(k, k, "v") for k in range(20)], SCHEMA), path, "case_id", 16)
    with pytest.raises(ValueError, match="left the touched buckets"):
        store.change(spark, path, SCHEMA, "case_id", spark.createDataFrame([(1, 1, "w")], SCHEMA), lambda old, x: old.withColumn("case_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))), 16)
