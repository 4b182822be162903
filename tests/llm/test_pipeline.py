"""The pipeline stage by stage on a small folder of documents."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from rulefact.llm import quality
from rulefact.llm.common import encode
from tests.llm.test_operators import SCHEMA, brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(400)]
    rows = []
    for i in range(240):
        words = [r.choice(vocab) for _ in range(r.randint(60, 140))]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
    for i in range(240, 300):  # near copies
        words = rows[i % 40][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "s1", 1))
    rows += [(300, None, "en", None, 0), (301, "", "en", "s1", 0), (302, "!!! BUY ### NOW " * 40, "en", "s2", 1), (None, rows[3][1] + " tail", None, None, None), (5, rows[5][1], "en", "s2", 1)]
    path = str(tmp_path_factory.mktemp("in"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_in_order_keep_columns_and_do_their_work(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, folder).cache()
    judged = {str(r.doc_id): r.kept for r in quality.judge(quality.ledger(docs)).collect()}
    assert first.columns == docs.columns
    assert sorted(str(r.doc_id) for r in first.collect()) == sorted(str(r.doc_id) for r in docs.collect() if judged[str(r.doc_id)])
    assert not {300, 301, 302} & {r.doc_id for r in first.collect()}

    second = corpus_pipeline.near_duplicates(spark, first, folder).cache()
    rows = [(r.doc_id, r.text) for r in first.collect()]
    _, root = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5)  # every row for itself, also without doc_id
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(root[k], []).append((doc_id is None, doc_id or 0, text))
    assert second.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in second.collect()) == sorted(min(g)[:2] for g in groups.values())
    assert None in {d for d, _ in rows} and None not in {r.doc_id for r in second.collect()}  # it copies document 3

    third = corpus_pipeline.mix_sources(spark, second, folder).cache()
    assert third.columns == docs.columns
    assert set(third.select("doc_id", "text").collect()) <= set(second.select("doc_id", "text").collect())
    words = lambda df: Counter({k: v for k, v in df.selectExpr("source", "size(split(text, ' ')) AS n").groupBy("source").sum("n").collect()})
    assert abs(sum(words(third).values()) - sum(words(second).values())) < 600

    last = corpus_pipeline.pack_sequences(spark, third, folder)
    assert last.agg({"length": "sum"}).first()[0] == sum(len(encode(r.text)) + 1 for r in third.collect())


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda df: sorted(map(str, df.groupBy("doc_id").agg({"length": "sum"}).collect()))
    assert key(docs) == key(corpus_pipeline.run(spark, folder))


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.withColumns({c: docs["doc_id"] for c in ("node", "row_key", "mix_key", "measured", "bucket", "size", "tag")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, extra, folder)
        assert out.count() > 0
        if name != "packing":
            assert out.columns == extra.columns and out.where("NOT (node <=> doc_id) OR NOT (mix_key <=> doc_id) OR NOT (row_key <=> doc_id)").count() == 0, name
