"""The queries that apply each corpus operator to its whole table, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefact.llm import ann, chat, hpylm, mixing, neardup, negatives, packing, phrases, pieces, quality, sharding, token_counts, urls
from rulefact.llm.common import read_table


def op1_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), urls.RULES, urls.train(urls.labelled_urls(spark)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(read_table(spark, sf_dir, "documents"), limits=[1 << k for k in range(7, 18)], shares=[0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read_table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op7_hpy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(read_table(spark, sf_dir, "documents"))


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(quality.ledger(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policies v1 and v2 rejects, alone and with others: from counts of bit patterns."""
    rows = quality.ledger(read_table(spark, sf_dir, "documents")).groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    found = [quality.ablations(rows, p, F.sum("n")).withColumn("policy", F.lit(p)) for p in ("v1", "v2")]
    return found[0].unionByName(found[1])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read_table(spark, sf_dir, "conversations"))


def op11_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(read_table(spark, sf_dir, "documents"), decoded=True)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), label)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"), least=30, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_forest_search, op2_url_filter, op3_token_counts, op4_setsketch_dedup, op5_packing, op6_ring_shards, op7_hpy_scores, op8_quality_ledger, op9_mixing, op10_chat_repair, op11_piece_ids, op12_hard_negatives, op13_collocations, quality_ablations]
    return {f.__name__: f for f in found}


_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LEDGER = (
    "WITH w AS (SELECT doc_id, coalesce(text, '') AS t, " + _SPLIT.format("coalesce(text, '')") + " AS w FROM documents), "
    "g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)), "
    "r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), "
    "c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1), "
    "l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: len(" + _SPLIT.format("x").replace("lambda x: x", "lambda y: y") + ") > 0) AS l FROM w), "
    "m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, "
    "length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, "
    "length(t) - length(replace(t, '!', '')) AS n_bangs, "
    "len(list_filter(w, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[a-z]'))) AS n_capital_words "
    "FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)), "
    "b AS (SELECT *, CAST(" + " + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, (_, test) in enumerate(quality.RULES)) + " AS BIGINT) AS fail_bits FROM m) "
)

_OP8 = _LEDGER + (
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & "
    f"{quality.POLICIES['base']} <> 0 AS base_failed, fail_bits & {quality.POLICIES[quality.CURRENT]} = 0 AS kept, fail_bits, '{quality.CURRENT}' AS policy FROM b"
)

_ABLATIONS = _LEDGER + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, '{rule}' AS rule, count_if(fail_bits & {bit} <> 0) AS n_failed, count_if(fail_bits & {quality.POLICIES[p]} = {bit}) AS n_only_this, count_if(fail_bits & {quality.POLICIES[p] - bit} = 0) AS n_kept_without FROM b"
    for p in ("v1", "v2") for rule, bit in quality.BIT.items() if bit & quality.POLICIES[p]
)

_OP4 = (
    "WITH RECURSIVE w AS (SELECT doc_id, " + _SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + " AS w FROM documents), "
    "s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)), "
    "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), "
    "p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2), "
    "e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)), "
    "u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), "
    "r(id, reach) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reach), "
    "c AS (SELECT id, min(reach) AS root FROM r GROUP BY 1) "
    "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, d.doc_id = coalesce(c.root, d.doc_id) AS kept "
    "FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"
)


_OP12 = (
    "WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings "
    "WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0), "
    "p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5), "
    "n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score) "
    "SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"
)

_GRAM = "SELECT lang, w[i:i + {k} - 1] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM w WHERE len(w) >= {k})"

_OP13 = (
    "WITH s AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents), "
    "w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM s), "
    "n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1), "
    "f AS (SELECT lang, p, count(*) AS f FROM (" + " UNION ALL ".join(_GRAM.format(k=k) for k in (1, 2, 3, 4)) + ") GROUP BY 1, 2 HAVING count(*) >= 30), "
    "c AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1), "
    "x AS (SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score FROM c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]), "
    "b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1), "
    "i AS (SELECT lang, p[j:j + m - 1] AS p, max(f) AS m FROM (SELECT lang, p, f, m, unnest(range(1, len(p) - m + 2)) AS j FROM (SELECT lang, p, f, unnest(range(2, len(p))) AS m FROM f WHERE len(p) > 2)) GROUP BY 1, 2), "
    "o AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN i ON i.lang = b.lang AND i.p = b.p WHERE i.m IS NULL OR 100 * i.m < 80 * b.a) "
    "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) "
    "QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"
)


def oracle_sql() -> dict[str, str]:
    """The others sample, hash, tokenize or train, which SQL cannot express; tests hold them against brute force."""
    return {"op12_hard_negatives": _OP12, "op13_collocations": _OP13, "op4_setsketch_dedup": _OP4, "op8_quality_ledger": _OP8, "quality_ablations": _ABLATIONS}
