"""Phrases of words that occur together more than their parts suggest, counted exactly in HAT-tries.

Counting: each task keeps a shallow trie over word ids. Its leaves are hash containers of the words that follow; a container that
outgrows BURST becomes a node of the next word. When a trie holds MOST entries, its largest subtrees are spilled whole, as sorted
runs. Runs are dealt by prefix, cut into chunks, and merged in order of their first phrases; only chunks that overlap wait in
memory. A prefix partition is given by the first word; words frequent enough to overfill one take several, by what follows.
Word ids are 64-bit hashes, drawn anew until no two words of the corpus share one.

Counting goes in two passes, for words and pairs, then for three and four words. A phrase can be frequent only if its parts are,
so parts are looked up in a bit table of BITS bits of the frequent ones (of fixed size, whatever the input). It never misses a
frequent part; what it lets through besides is counted and falls below the bound. So all counts of frequent phrases are exact.

Defined cases: a null or empty text has no words; a null lang is `und`; repeated rows count each time; phrases do not cross the
ends of pieces or texts; very long texts and words are read whole; doc_ids are not read, nor are other columns; an empty table
gives an empty result. Ties are exact: scores are compared after flooring, phrases by their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefact.llm.common import _LOWER, Texts, mix, slices, stored

#: Entries of a leaf container and of a whole trie; phrases in a chunk of a run; words to a prefix partition, and most of these.
BURST, MOST, CHUNK, PER_PART, MOST_PARTS = 4096, 1 << 19, 2048, 1 << 20, 1 << 14
#: Size of the tables of frequent parts: 2^25 bits are 4 MB.
BITS = 25
LONGEST = 4

_CUT, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True

_RUNS = "bucket int, lang string, first binary, keys binary, counts binary"
_GRAMS = "lang string, words array<long>, n long"


def _word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, chunk: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each run data[start:end], lower-cased: the sum of one random number for each byte and place."""
    out, at = np.empty(len(starts), np.uint64), 0
    salt = mix(np.array([seed], np.uint64) + np.uint64(0x5851F42D4C957F2D))[0]
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, "right")))
        s, lengths = starts[at:to], ends[at:to] - starts[at:to]
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        value = _LOWER[data[inside + np.repeat(s, lengths)]].astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(8))
        out[at:to] = np.add.reduceat(mix(value ^ salt), first)
        at = to
    return mix(out)


class Words:
    """The words of some texts: id, start and end byte, the text each lies in, and whether the next word follows in its piece."""

    def __init__(self, texts: Texts, seed: int):
        data = texts.data
        cut = _CUT[data]
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~(cut | _GAP[data])
        edge = np.zeros(len(data) + 1, bool)
        edge[texts.offsets] = True
        self.data = data
        self.starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        self.ids = _word_ids(data, self.starts, self.ends, seed)
        self.text = np.searchsorted(texts.offsets, self.starts, "right") - 1
        piece = np.cumsum(cut)[self.starts] if len(data) else self.starts
        self.next = np.zeros(len(self.starts), bool)
        self.next[:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])


def _slices(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[str, Words]]:
    """The words of a batch of (lang, text), language by language."""
    langs = batch.column(0).dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        for _, part in slices(batch.column(1).filter(pa.array(np.asarray(langs.indices) == k)), 1 << 23):
            yield lang, Words(Texts(part), seed)


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, w in _slices(batch, seed):
                ids, first, n = np.unique(w.ids, return_index=True, return_counts=True)
                text = w.data.tobytes()
                found = [text[a:b].lower() for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist())]  # bytes.lower: A-Z only
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(ids.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "word", "id", "n"])

    return run


class Burst(dict):
    """A node of the trie: by the next word's 8 bytes, a node or a container (a plain dict: the words that follow -> count)."""


class HatTrie:
    """Counts of phrases, each given as the bytes of its word ids (8 each, big-endian, so that byte order is word order)."""

    def __init__(self, burst: int = BURST):
        self.root, self.burst, self.size = Burst(), burst, 0

    def add(self, words: np.ndarray, counts: np.ndarray) -> None:
        """Phrases as rows of big-endian word ids, sorted, each once."""
        width = words.shape[1] * 8
        raw, counts = words.tobytes(), counts.tolist()
        ends = np.flatnonzero(np.append(words[1:, 0] != words[:-1, 0], True)) + 1
        at = 0
        for end in ends.tolist():
            first = raw[at * width : at * width + 8]
            node = self.root.get(first)
            if node is None:
                node = self.root[first] = {}
            if type(node) is dict:
                before = len(node)
                for p, n in zip(range(at * width + 8, end * width, width), counts[at:end]):
                    rest = raw[p : p + width - 8]
                    node[rest] = node.get(rest, 0) + n
                self.size += len(node) - before
                if len(node) > self.burst:
                    self.root[first] = self._burst(node)
            else:
                for p, n in zip(range(at * width + 8, end * width, width), counts[at:end]):
                    self._put(node, raw[p : p + width - 8], n)
            at = end

    def _put(self, node: Burst, rest: bytes, n: int) -> None:
        while True:
            word, rest = rest[:8], rest[8:]
            child = node.get(word)
            if type(child) is Burst:
                node = child
                continue
            if child is None:
                child = node[word] = {}
            self.size += rest not in child
            child[rest] = child.get(rest, 0) + n
            if len(child) > self.burst:
                node[word] = self._burst(child)
            return

    def _burst(self, container: dict) -> dict:
        """The container as a node, if more than one word follows in it."""
        if max(map(len, container)) <= 8:
            return container
        node = Burst()
        for rest, n in container.items():
            node.setdefault(rest[:8], {})[rest[8:]] = n
        return node

    def entries(self, node: dict, prefix: bytes) -> Iterator[tuple[bytes, int]]:
        if type(node) is dict:
            for rest, n in node.items():
                yield prefix + rest, n
        else:
            for word, child in node.items():
                yield from self.entries(child, prefix + word)

    def count(self, node: dict) -> int:
        return len(node) if type(node) is dict else sum(map(self.count, node.values()))

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes the largest subtrees out until `keep` entries are left: phrases of one length and counts, sorted, for each length."""
        taken: dict[int, tuple[list[bytes], list[int]]] = {}
        for first in sorted(self.root, key=lambda x: self.count(self.root[x]), reverse=True):
            if self.size <= keep:
                break
            node = self.root.pop(first)
            self.size -= self.count(node)
            for phrase, n in self.entries(node, first):
                keys, counts = taken.setdefault(len(phrase) // 8, ([], []))
                keys.append(phrase)
                counts.append(n)
        for k, (keys, counts) in sorted(taken.items()):
            words = np.frombuffer(b"".join(keys), ">u8").reshape(-1, k)
            order = np.lexsort(words.T[::-1])
            yield words[order], np.array(counts, np.int64)[order]


def _sums(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal phrases together, in order."""
    order = np.lexsort(words.T[::-1])
    words, counts = words[order], counts[order]
    new = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1))) if len(words) else np.zeros(0, np.int64)
    return words[new], np.add.reduceat(counts, new) if len(new) else counts


class Parts:
    """Prefix partitions: by the first word, several for words (`hot`, with their number of partitions) that would overfill one."""

    def __init__(self, parts: int, hot: dict[int, int]):
        self.parts = parts
        self.hot = np.array(sorted(hot), np.uint64)
        self.several = np.array([hot[w] for w in sorted(hot)], np.uint64)

    def of(self, words: np.ndarray) -> np.ndarray:
        first, rest = words[:, 0].astype(np.uint64), np.zeros(len(words), np.uint64)
        for k in range(1, words.shape[1]):
            rest = mix(rest + words[:, k].astype(np.uint64))
        several = np.ones(len(words), np.uint64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            several = np.where(self.hot[at] == first, self.several[at], several)
        return ((mix(first) + rest % several) % np.uint64(self.parts)).astype(np.int64)


def _place(ids: list, bits: int):
    """The place of a part in the table of bits, from its word ids: alike for columns and arrays."""
    x = ids[0]
    if isinstance(x, Column):
        for y in ids[1:]:
            x = (F.shiftleft(x, 21).bitwiseOR(F.shiftrightunsigned(x, 43))).bitwiseXOR(y)
        return x.bitwiseAND(F.lit((1 << bits) - 1))
    for y in ids[1:]:
        x = ((x << np.uint64(21)) | (x >> np.uint64(43))) ^ y
    return x & np.uint64((1 << bits) - 1)


def _bit_table(parts: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, with the places of parts (columns of word ids) set: at most 2^(bits - 6) rows of 16 bytes come to the driver."""
    place = _place([F.col(c) for c in parts.columns], bits)
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    found = parts.select(place.alias("place")).groupBy(F.shiftrightunsigned("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _has(table: np.ndarray, ids: list[np.ndarray], bits: int) -> np.ndarray:
    p = _place(ids, bits)
    return (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def _phrases(w: Words, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct phrases of k words that begin at the places `keep`, sorted, and their counts."""
    at = np.flatnonzero(keep)
    _, dense = np.unique(w.ids, return_inverse=True)
    size, code = int(dense.max(initial=0)) + 1, dense[at]
    for j in range(1, k):
        if j > 1:
            _, code = np.unique(code, return_inverse=True)
        code = code * size + dense[at + j]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return np.stack([w.ids[at[first] + j] for j in range(k)], axis=1).astype(">u8"), n


def _runs(seed: int, shared, lengths: tuple[int, ...], parts: Parts, bits: int, burst: int, most: int):
    """Sorted runs of the phrases whose parts the table has: single words for pairs, pairs for longer ones."""

    def rows(lang: str, spilled: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for words, counts in spilled:
            part = parts.of(words)
            order = np.argsort(part, kind="stable")
            words, counts, part = words[order], counts[order], part[order]
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            cuts = sorted({*edges.tolist(), *(c for a, b in zip(edges, [*edges[1:], len(part)]) for c in range(a, b, CHUNK))}) + [len(part)]
            out = [(int(part[a]), words[a].tobytes(), words[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            for at in range(0, len(out), 4096):
                bucket, first, keys, n = zip(*out[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([lang] * len(bucket), pa.string()), *(pa.array(x, pa.binary()) for x in (first, keys, n))], names=["bucket", "lang", "first", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tries = shared.value, {}
        for batch in batches:
            for lang, w in _slices(batch, seed):
                if len(w.ids) < 2:
                    continue
                pair = w.next.copy()
                if 2 in lengths:
                    known = _has(table, [w.ids], bits)
                    pair[:-1] &= known[:-1] & known[1:]
                else:
                    pair[:-1] &= _has(table, [w.ids[:-1], w.ids[1:]], bits)
                begins = pair  # of k words in one piece, all their parts in the table
                for k in range(2, max(lengths) + 1):
                    if k > 2:
                        begins = begins & np.append(pair[k - 2 :], np.zeros(min(k - 2, len(pair)), bool))
                    if k in lengths and begins.any():
                        tries.setdefault(lang, HatTrie(burst)).add(*_phrases(w, begins, k))
                while sum(t.size for t in tries.values()) > most:
                    lang_, trie = max(tries.items(), key=lambda x: x[1].size)
                    yield from rows(lang_, trie.spill(trie.size // 2))
        for lang, trie in tries.items():
            yield from rows(lang, trie.spill())

    return run


def _merged(least: int):
    """Chunks of sorted runs, in order of partition and first phrase, to the phrases counted `least` times or more."""

    def out(lang: str, words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, counts = words[counts >= least], counts[counts >= least]
        for at in range(0, len(words), 1 << 16):
            part = words[at : at + (1 << 16)].astype(np.uint64).view(np.int64)
            offsets = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel())), pa.array(counts[at : at + (1 << 16)])], names=["lang", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, size = None, [], 0  # what waits is of one partition, language and length

        def settle(before: bytes | None) -> Iterator[pa.RecordBatch]:
            """Everything before a phrase is complete: it is summed and leaves."""
            nonlocal waiting, size
            words, counts = _sums(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]))
            to = len(words)
            if before is not None:
                low, to = 0, len(words)
                while low < to:
                    mid = (low + to) // 2
                    low, to = (mid + 1, to) if words[mid].astype(">u8").tobytes() < before else (low, mid)  # joined arrays are in native byte order
            yield from out(at[1], words[:to], counts[:to])
            waiting = [(words[to:], counts[to:])] if to < len(words) else []
            size = len(words) - to

        limit = CHUNK * 64
        for batch in batches:
            for bucket, lang, first, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                here = bucket, lang, len(first)
                if here != at:
                    if waiting:
                        yield from settle(None)
                    at, waiting, size, limit = here, [], 0, CHUNK * 64
                elif size >= limit:
                    yield from settle(first)
                    limit = max(CHUNK * 64, 2 * size)
                waiting.append((np.frombuffer(keys, ">u8").reshape(-1, len(first) // 8), np.frombuffer(n, np.int64)))
                size += len(waiting[-1][1])
        if waiting:
            yield from settle(None)

    return run


def count_phrases(docs: DataFrame, least: int, bits: int = BITS, burst: int = BURST, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """All words (lang, word, id, n), and the phrases of 2 to LONGEST words found `least` times or more (lang, words, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    seed = 0
    while True:
        counted = rows.mapInArrow(_count_words(seed), "lang string, word string, id long, n long")
        words = stored(counted.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), "phrase-words")
        if words.groupBy("id").agg((F.min("word") != F.max("word")).alias("shared")).where("shared").isEmpty():
            break
        seed += 1
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = min(max(-(-total // PER_PART), int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_PARTS)
    share = max(total / parts, 1)
    hot = {r["id"] % (1 << 64): int(-(-r["n"] // share)) for r in words.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") > share).collect()}  # fewer than `parts`
    deal = Parts(parts, hot)

    def pass_(known: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
        shared = spark.sparkContext.broadcast(_bit_table(known, bits))
        runs = rows.mapInArrow(_runs(seed, shared, lengths, deal, bits, burst, most), _RUNS)
        runs = runs.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang", F.length("first"), "first")
        return stored(runs.mapInArrow(_merged(least), _GRAMS), "phrases")

    pairs = pass_(words.where(F.col("n") >= least).select(F.col("id").alias("a")), (2,))
    longer = pass_(pairs.select(F.col("words")[0].alias("a"), F.col("words")[1].alias("b")), tuple(range(3, LONGEST + 1)))
    return words, pairs.unionByName(longer)


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = 30, scale: int = 2_000_000, inside: int = 80, top: int = 2000, **memory: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to 4 words found `least` times or more.

    A phrase's score is that of its lowest cut, floor(scale * a / (l + r)); phrases that lie inside a longer one found at least
    `inside` percent as often are dropped.
    """
    words, phrases = count_phrases(docs, least, **memory)
    known = words.where(F.col("n") >= least).select("lang", F.array("id").alias("words"), "n").unionByName(phrases)
    cuts = phrases.select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("cut")), "right": F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut"))})
    part = lambda side, name: known.select("lang", F.col("words").alias(side), F.col("n").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"CAST({scale} AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(38,0)) + r)"))
    scored = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))

    # Of each phrase of three and more words, the phrases inside it.
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k))))
    longer = phrases.where(F.size("words") > 2).select("lang", F.explode(within).alias("words"), F.col("n").alias("m")).groupBy("lang", "words").agg(F.max("m").alias("m"))
    kept = scored.join(longer, ["lang", "words"], "left").where(F.col("m").isNull() | (100 * _wide(F.col("m")) < inside * _wide(F.col("a"))))

    spelled = kept.select("lang", "words", "a", "x", F.posexplode("words").alias("k", "id")).join(words.where(F.col("n") >= least).select("lang", "id", "word"), ["lang", "id"])
    spelled = spelled.groupBy("lang", "words", "a", "x").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda y: y["word"])).alias("phrase"))
    order = [F.desc("x.score"), F.desc("a"), "phrase"]
    first = spelled.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(32)))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", F.col("x.score").cast("long").alias("score"))
