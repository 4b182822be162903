from rulefact.streaming import temporal

SF = "/root/testdata/sf0.001"


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = temporal.windowed_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "1 day", "400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.window.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("counts")) == key(temporal.windowed_counts(batch)) != []


def test_late_followers_in_batch(spark):
    a = spark.sql("SELECT 1 AS k, TIMESTAMP '2026-01-10 10:00:00' AS ts UNION ALL SELECT 2, TIMESTAMP '2026-01-10 10:00:00'")
    b = spark.sql("SELECT 1 AS k, TIMESTAMP '2026-01-10 09:00:00' AS ts UNION ALL SELECT 2, TIMESTAMP '2026-01-10 11:00:00'")
    assert [r.key for r in temporal.late_followers(a, b, "k", "1 day").collect()] == [1]


def test_missing_followers_over_restarts_equal_the_batch(spark, tmp_path):
    """The stream stops, goes on from its checkpoint with new files, and tells what the tables tell."""
    day = lambda n: f"TIMESTAMP '2026-01-01 00:00:00' + INTERVAL {n} DAYS"
    rows = lambda pairs: spark.sql(" UNION ALL ".join(f"SELECT CAST({k} AS INT) AS k, {day(n)} AS ts" for k, n in pairs))
    parts = [([(1, 0), (2, 0), (3, 1), ("NULL", 1)], [(1, 5), (3, 20)]), ([(4, 30), (5, 31)], [(4, 29), (2, 31), ("NULL", 31)]), ([(6, 33), (-1, 400)], [(6, 43), (5, 42), (-1, 400)])]
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    for a, b in parts:
        rows(a).write.mode("append").parquet(str(tmp_path / "a"))
        rows(b).write.mode("append").parquet(str(tmp_path / "b"))
        read = lambda x: spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / x))
        temporal.write_available(temporal.missing_followers(read("a"), read("b"), "k", "10 DAYS", "5 DAYS"), str(tmp_path / "out"), str(tmp_path / "ck"))
    table = lambda x: spark.read.schema("k int, ts timestamp").parquet(str(tmp_path / x))
    batch = temporal.missing_followers(table("a"), table("b"), "k", "10 DAYS")
    key = lambda df: sorted((r.key, str(r.a)) for r in df.where("key > 0").collect())
    told = key(spark.read.schema("key int, a timestamp").parquet(str(tmp_path / "out")))
    assert told == key(batch) and [k for k, _ in told] == [2, 3, 4, 5]


def test_files_are_taken_once(spark, tmp_path):
    from rulefact.streaming import ingest

    folder, into = tmp_path / "in", str(tmp_path / "into")
    (folder / "sub").mkdir(parents=True)
    (folder / "TC-1.txt").write_text("  first text\n")
    (folder / "TC-2.txt").write_text("first text")
    (folder / "TC-3.txt").write_text(" \n\t")
    (folder / "TC-4.txt").write_bytes(b"bad \xff\xfe text")
    (folder / "note.md").write_text("other")
    see = lambda: tuple(sorted(tuple(r) for r in x.collect()) for x in (ingest.ingested(spark, into)[0].select("case_id", "content"), ingest.ingested(spark, into)[1].select("case_id", "kind")))
    assert see() == ([], [])
    ingest.ingest(spark, str(folder), into)
    once = ([("TC-1", "first text")], [("TC-2", "duplicate"), ("TC-3", "blank"), ("TC-4", "not_utf8")])
    assert see() == once
    ingest.ingest(spark, str(folder), into)
    assert see() == once
    (folder / "sub" / "TC-1.txt").write_text("another text")
    (folder / "sub" / "TC-5.txt").write_text("first text")
    (folder / "sub" / "TC-6.txt").write_text("new")
    texts, errors = ingest.ingest(spark, str(folder), into)
    assert see() == (once[0] + [("TC-6", "new")], [("TC-1", "known_case")] + once[1] + [("TC-5", "duplicate")])
    assert {r.source_id for r in texts.collect()} == {"TC-1-TEXT", "TC-6-TEXT"}


def test_first_of_equal_texts_counts_in_any_batch(spark, tmp_path):
    from rulefact.streaming import ingest

    folder, into = tmp_path / "texts", str(tmp_path / "into")
    for name in ("doc=2", "doc=10", "doc=3"):  # the last by path comes first
        (folder / name).mkdir(parents=True)
        (folder / name / "x.txt").write_text("same")
        texts, errors = ingest.ingest(spark, str(folder), into, case_of=r"doc=(\d+)/")
    assert [r.case_id for r in texts.collect()] == ["2"]
    first, again = ingest.settled(texts, errors)
    assert [r.case_id for r in first.collect()] == ["10"] and sorted(r.case_id for r in again.collect()) == ["2", "3"]


def test_many_small_files_are_written_listed_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """One file for each text, in few folders whose paths sort as names do; where Arrow does not reach, Spark's writer makes them."""
    import os

    from types import SimpleNamespace

    from rulefact.sources import records
    from rulefact.streaming import ingest

    sc, case_of = spark.sparkContext, r"(\d+)(?:\.txt|/part-[^/]*)$"
    text = lambda k: f" text {k % 100} \n" if k % 50 else ""
    texts = spark.createDataFrame([(k, text(k)) for k in range(8, 208)], "name long, text string")

    def last_stage():
        sc.setJobGroup(mark := f"mark-{os.urandom(4).hex()}", "")
        spark.range(1).rdd.count()
        return max(s for j in sc.statusTracker().getJobIdsForGroup(mark) for s in sc.statusTracker().getJobInfo(j).stageIds)

    def unreached(uri):
        raise OSError(uri)

    kinds = {}
    for way in ("arrow", "spark"):
        folder = tmp_path / way
        if way == "spark":
            monkeypatch.setattr(records, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=unreached)))
        records.write_texts(texts, f"file://{folder}", 60)
        files = sorted(p.relative_to(folder) for p in folder.rglob("*.txt"))
        assert len(files) == 200
        if way == "arrow":
            assert [p.stem for p in files] == sorted(str(k) for k in range(8, 208)) and files[1].parts == ("100", "100.txt")
            assert (folder / "9" / "9.txt").read_bytes() == b" text 9 \n\n"
        first = last_stage()
        taken, errors = ingest.ingest(spark, f"file://{folder}", str(tmp_path / f"into-{way}"), case_of=case_of)
        sizes = [i.numTasks for s in range(first + 1, last_stage()) if (i := sc.statusTracker().getStageInfo(s))]
        assert sizes and max(sizes) <= 4 * sc.defaultParallelism
        kinds[way] = sorted(tuple(r) for r in taken.selectExpr("case_id", "'text'", "content").union(errors.selectExpr("case_id", "kind", "null")).collect())
        assert [r[0] for r in kinds[way]] == sorted(str(k) for k in range(8, 208))
    assert kinds["arrow"] == kinds["spark"]
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
