"""Rule bitmask ledger: measure each document once, keep failure bits, then apply policies and ablations to the bits.

Defined cases: a null or empty text has no words and fails `few_words`; a null or repeated doc_id is an ordinary row;
columns of the input other than doc_id and text are not read (an input column named like a measurement cannot clash); very long
texts are measured whole, a few MB of text at a time; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefact.llm.common import Texts, free_name, hash_runs, mix, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capital_words")

#: Rule k sets bit k of the ledger. Integer arithmetic only, so every engine agrees.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "10 * n_bangs > 2 * n_words"),
    ("capitals", "n_words >= 20 AND 10 * n_capital_words > 4 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: A policy is a mask of the rules that reject; versions stay, so that old ledgers can be judged again.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeats"],
    "v1": sum(BIT.values()) - BIT["capitals"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _measure(texts: Texts) -> list[np.ndarray]:
    data, n = texts.data, texts.n
    starts, ends, first = texts.words()
    counts = np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    solid = np.zeros(len(data) + 1, np.int8)
    np.add.at(solid, starts, 1)
    np.add.at(solid, ends, -1)
    in_word = np.cumsum(solid, dtype=np.int8)[:-1].astype(bool)
    word_chars = _per_text(in_word & ((data & 0xC0) != 0x80), texts.offsets)
    symbols, bangs = _per_text(_SYMBOL[data], texts.offsets), _per_text(data == 33, texts.offsets)

    words = hash_runs(data, starts, ends)
    salt = mix(owner.astype(np.uint64) + np.uint64(1))
    repeat = np.zeros(len(words) + 2, bool)
    if len(words) >= 3:
        ok = owner[2:] == owner[:-2]
        key = mix(mix(mix(words[:-2] ^ salt[:-2]) + words[1:-1]) + words[2:])[ok]
        at = np.flatnonzero(ok)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for k in range(3):
            repeat[hit + k] = True
    n_repeat = _per_text(repeat[: len(words)], first)

    capital = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=capital[1:])
    small = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 97) & (data <= 122), out=small[1:])
    n_capital = _per_text((capital[ends] - capital[starts] >= 2) & (small[ends] == small[starts]), first)

    cut = np.zeros(len(data) + 1, bool)
    cut[texts.offsets] = True
    cut[1:][data == 10] = True
    line_at = np.flatnonzero(cut)
    line_of = np.searchsorted(line_at, starts, "right") - 1
    with_word = np.unique(line_of)
    begin = line_at[with_word]
    stop = np.append(line_at, len(data))[with_word + 1]
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10) if len(stop) else 0)
    holder = np.searchsorted(texts.offsets, begin, "right") - 1
    lines = np.bincount(holder, minlength=n)
    key = mix(hash_runs(data, begin, stop) ^ mix(holder.astype(np.uint64) + np.uint64(1)))
    _, seen = np.unique(key, return_index=True)
    fresh = np.bincount(holder[seen], minlength=n)
    return [counts, word_chars, symbols, lines - fresh, n_repeat, lines, bangs, n_capital]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in slices(batch.column(1)):
            found = _measure(Texts(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(np.asarray(x, np.int64)) for x in found)], names=["doc_id", *MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text; one pass, no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_batches, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def fail_bits(rules: list[tuple[str, str]] = RULES, inside: str | None = None) -> Column:
    """All rules in one number: bit k is set if rule k fails the document. inside: the struct column that holds the measurements."""
    bits = F.lit(0).cast("long")
    for k, (_, test) in enumerate(rules):
        if inside:
            test = re.sub(r"\bn?_?[a-z]+(?:_[a-z]+)*\b", lambda m: f"`{inside}`.{m[0]}" if m[0] in MEASURES else m[0], test)
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and fail_bits of each document: every rule evaluated once, no verdict yet."""
    return measure(docs).withColumn("fail_bits", fail_bits())


def judge(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds kept under a policy and the only rule that rejects, where there is just one."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
    return rows.withColumns({
        "policy": F.lit(policy),
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0,
        "kept": hit == 0,
        "sole_rule_bit": F.when(F.bit_count(hit) == 1, hit),
    })


def ablations(rows: DataFrame, policy: str = CURRENT, number: Column | None = None) -> DataFrame:
    """For each rule of a policy: documents it fails, documents only it rejects, and documents kept without it.

    Works on counts per distinct bit pattern (at most 2**rules rows), so a new policy costs no pass over the texts.
    number: how many documents a group of rows stands for, if the rows are counts themselves.
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg((F.count(F.lit(1)) if number is None else number).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask)))
    x = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return x.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only_this"),
        total(others == 0).alias("n_kept_without"),
    )


def kept_documents(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents a policy keeps, with all their columns, whatever their names: the measurements run beside the rows, so no
    join is needed, and the rules are those of the ledger."""
    at, name = docs.columns.index("text"), free_name(docs, "measured")
    measured = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column(at)):
                found = pa.StructArray.from_arrays([pa.array(np.asarray(x, np.int64)) for x in _measure(Texts(part))], names=list(MEASURES))
                own = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, found], names=[*own.schema.names, name])

    rows = docs.mapInArrow(beside, T.StructType([*docs.schema.fields, T.StructField(name, measured)]))
    return rows.where(fail_bits(inside=name).bitwiseAND(F.lit(POLICIES[policy])) == 0).drop(name)
