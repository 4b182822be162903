"""Scoring documents with a hierarchical Pitman-Yor language model trained on the corpus.

Restaurants are contexts: the two words before, whose tables are customers of the word before, whose tables are customers of one
restaurant over all words, whose base is uniform over the known words and one unknown. Every context is a restaurant of its own
(words are told apart by WORD_BYTES bytes of their hash; texts begin with two start words). Seatings are sampled by blocked
Gibbs: a sweep draws the tables of every dish anew from their conditional given the parent's probabilities; discounts and
strengths are drawn from their conditionals on a grid (griddy Gibbs). Predictive probabilities are averaged over the samples
after burn-in.

The work is laid out so that no context and no word is gathered whole:
events   each task turns documents into blocks of about BLOCK_TOKENS tokens; a block sends each bucket its events (word and the
         two before it, by a dictionary of the message; document). Messages are never empty, so there are fewer of them than tokens
buckets  a bucket holds all events of its contexts (hash ranges of the word before), so both restaurants of an event are local. A
         word before which has more than half of BUCKET_TOKENS is parted by the word before it into restaurants of at least that size
words    buckets first sweep by themselves, then send the tables of each word to the ranges of words, where the restaurant over
         all words is seated, and get back its customers, tables and the training count of each of their words
answers  buckets sweep again with that parent and send each block the sums of its documents
The events are dealt out once; both passes over the buckets read the same exchange.

Defined cases: a null or empty text is the end alone; a null doc_id counts as an empty text in the hold-out rule (training);
repeated rows count each time; very long texts are read whole and may lie in a block of their own; other columns are not read;
with no training tokens every token is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.llm.common import Texts, mix, slices, stored

BLOCK_TOKENS, BUCKET_TOKENS = 1 << 22, 1 << 20
#: Sweeps of the first pass, and of the second before and while samples are taken.
FIRST, BURN_IN, SAMPLES = 2, 2, 3
#: Dishes of up to so many customers get their tables from the exact conditional; larger ones are seated one after another in
#: growing steps, in which the chance of a new table hardly moves.
EXACT = 128
FOLDS, HELD_OUT = 7, 2
WORD_BYTES = 6
_CUT = np.uint64(64 - 8 * WORD_BYTES)
END, START = mix(np.array([0xE0D, 0x57A7], np.uint64)) >> _CUT
DISCOUNTS = np.round(np.arange(0.02, 0.99, 0.02), 2)
STRENGTHS = np.round(np.geomspace(0.05, 50, 31), 4)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte by byte of equal weight, as few bytes as the largest needs, compressed."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for x in arrays:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        x = x.astype(np.uint64, copy=False)
        parts += [np.array([len(x), width], "<i8").tobytes(), *((x >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width))]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = memoryview(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))
    out, at = [], 8
    for _ in range(int.from_bytes(raw[:8], "little")):
        n, width = np.frombuffer(raw[at : at + 16], "<i8")
        planes = np.frombuffer(raw[at + 16 : at + 16 + n * width], np.uint8).reshape(width, n)
        x = planes[0].astype(np.uint64)
        for k in range(1, width):
            x |= planes[k].astype(np.uint64) << np.uint64(8 * k)
        out.append(x)
        at += 16 + n * width
    return out


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in the order they come, and for each entry the number of its value."""
    found = pa.array(x).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _numbered_ascending(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, number = _numbered(x)
    order = np.argsort(values)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return values[order], place[number]


def _ascending(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which take fewer bytes."""
    return np.diff(x, prepend=np.zeros(1, x.dtype))


_EVENTS = "bucket long, block long, blob binary"


def _held(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: the first's number, the words (cut hashes, an end after each text) and the tokens of each text."""
    for at, part in slices(column):
        words, first = Texts(part).word_hashes(lower=True)
        counts = np.diff(first)
        yield at, np.insert(words >> _CUT, first[1:], END), counts + 1


def _frequent(share: float):
    """Words that hold at least `share` of a task's tokens, with their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, words, _ in _tokens(batch.column(1)):
                values, number = _numbered(words)
                held.append((values, np.bincount(number)))
                if len(held) == 16:
                    held = [_summed(held)]
        if held:
            words, counts = _summed(held)
            use = counts >= share * counts.sum()
            yield pa.RecordBatch.from_arrays([pa.array(words[use].astype(np.int64)), pa.array(counts[use])], names=["word", "n"])

    return run


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = _numbered(np.concatenate([w for w, _ in parts]))
    return words, np.bincount(at, np.concatenate([c for _, c in parts]), minlength=len(words)).astype(np.int64)


class Layout:
    """How contexts are dealt to buckets: hot words before are parted by the word before them."""

    def __init__(self, buckets: int, hot: dict[int, int]):
        self.buckets = buckets
        self.hot = np.array(sorted(hot), np.uint64)
        self.parts = np.array([hot[w] for w in sorted(hot)], np.uint64)

    def bucket(self, before: np.ndarray, ahead: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
        out = np.empty(len(before), np.uint16 if self.buckets < 1 << 16 else np.int64)
        for at in range(0, len(before), chunk):
            b, a = before[at : at + chunk], ahead[at : at + chunk]
            part = np.zeros(len(b), np.uint64)
            if len(self.hot):
                place = np.minimum(np.searchsorted(self.hot, b), len(self.hot) - 1)
                is_hot = self.hot[place] == b
                part[is_hot] = mix(a[is_hot]) % self.parts[place[is_hot]]
            out[at : at + chunk] = mix(mix(b) + part) % np.uint64(self.buckets)
        return out


def _block_rows(number: int, docs: list, words: np.ndarray, lengths: np.ndarray, layout: Layout) -> pa.RecordBatch:
    """Under bucket -1 - number the documents of a block, and for each bucket its events there in the order of documents."""
    held = np.array([_held(d) for d in docs])
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    second = np.minimum(first + 1, len(words) - 1)[lengths > 1]

    def before(x: np.ndarray, start: int | np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The entry before each and the one before that; texts begin with two start words."""
        one, two = np.roll(x, 1), np.roll(x, 2)
        one[first], two[first], two[second] = start, start, start
        return one, two

    bucket = layout.bucket(*before(words, START))
    dictionary, number_of = _numbered_ascending(np.append(words, START))
    del words
    start, number_of = number_of[-1], number_of[:-1]
    n1, n2 = before(number_of, start)
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=layout.buckets))))
    place = np.zeros(len(dictionary), np.int32)
    ids = np.array([d or 0 for d in docs], np.int64)
    rows = [(-1 - number, number, packed(ids.view(np.uint64), np.array([d is None for d in docs]), held, lengths))]
    for b in np.flatnonzero(np.diff(cuts)):
        x = order[cuts[b] : cuts[b + 1]]
        w, v1, v2 = number_of[x], n1[x], n2[x]
        if 4 * len(x) > len(dictionary):
            seen = np.zeros(len(dictionary), bool)
            seen[w], seen[v1], seen[v2] = True, True, True
            used = np.flatnonzero(seen)
        else:
            used = np.unique(np.concatenate((w, v1, v2)))
        place[used] = np.arange(len(used), dtype=np.int32)
        rows.append((int(b), number, packed(_ascending(dictionary[used]), place[w], place[v1], place[v2], _ascending(doc[x]), held[doc[x]])))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "block", "blob"])


def _events(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs: list = []
        words: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, some, counts in _tokens(batch.column(1)):
                docs += ids[at : at + len(counts)]
                words.append(some)
                lengths.append(counts)
                held += len(some)
                if held >= BLOCK_TOKENS:
                    yield _block_rows(number, docs, np.concatenate(words), np.concatenate(lengths), layout)
                    docs, words, lengths, held, number = [], [], [], 0, number + 1
        if docs:
            yield _block_rows(number, docs, np.concatenate(words), np.concatenate(lengths), layout)

    return run


@lru_cache(maxsize=None)
def _stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S_d(c, t) for c, t up to n: ways to seat c customers at t tables, weighted."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    t = np.arange(n + 1)
    for c in range(n):
        with np.errstate(divide="ignore"):
            stay = s[c] + np.log(np.maximum(c - t * d, 0))
        s[c + 1] = stay
        s[c + 1, 1:] = np.logaddexp(stay[1:], s[c, :-1])
    return s


def seat(c: np.ndarray, weight: np.ndarray, d: float, draw: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers each, where a new table weighs `weight` and an old one its customers less d."""
    t = np.minimum(c, 1)
    table = _stirling(d)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    some = some[np.argsort(c[some], kind="stable")]
    edges = np.searchsorted(c[some], np.arange(2, EXACT + 2))
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False), 2):
        for at in range(a, b, max(1, 1_000_000 // n)):
            rows = some[at : min(b, at + max(1, 1_000_000 // n))]
            p = table[n, 1 : n + 1] + np.log(weight[rows])[:, None] * np.arange(1, n + 1)
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            t[rows] = 1 + (draw.random(len(rows))[:, None] * p[:, -1:] > p).sum(axis=1)
    big = np.flatnonzero(c > EXACT)
    big = big[np.argsort(-c[big], kind="stable")]
    if len(big):
        seated, size, tables, w = 1, c[big], np.ones(len(big)), weight[big]
        while seated < size[0]:
            k = int(np.searchsorted(-size, -seated, "left"))  # dishes with customers still to seat
            step = max(1, seated // 64)
            m = np.minimum(step, size[:k] - seated)
            chance = np.clip(w[:k] / (w[:k] + np.maximum(seated - d * tables[:k], 1e-9)), 0, 1)
            tables[:k] += draw.binomial(m, chance)
            seated += step
        t[big] = tables
    return t


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers, by Stirling's series above 7."""
    z = x + 7
    below = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5) * (x + 6))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - below


def _log_rising(start: float, step: float, n: np.ndarray) -> np.ndarray:
    """log of (start + step)(start + 2 step)...(start + (n - 1) step) for each n of at least 1."""
    return (n - 1) * math.log(step) + _log_gamma(start / step + n) - math.lgamma(start / step + 1)


def resample(c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, strength: float, draw: np.random.Generator) -> tuple[float, float]:
    """Discount and strength of a level, each from its conditional over a grid, given customers and tables of its dishes (those of
    one customer may be left out: they say nothing) and, for each restaurant that is open, of the restaurant."""
    small = c <= EXACT
    n_dishes = np.bincount(c[small] * (EXACT + 1) + t[small])
    dishes = np.flatnonzero(n_dishes)
    n_dishes, dish_c, dish_t = n_dishes[dishes], dishes // (EXACT + 1), dishes % (EXACT + 1)
    n_t, n_c = np.bincount(tables), np.bincount(customers)
    t_of, c_of = np.flatnonzero(n_t), np.flatnonzero(n_c)
    n_t, n_c = n_t[t_of], n_c[c_of]

    def pick(grid: np.ndarray, logs: list[float]) -> float:
        p = np.exp(np.array(logs) - max(logs))
        return float(grid[min(np.searchsorted(np.cumsum(p), draw.random() * p.sum()), len(grid) - 1)])

    if not len(t_of):
        return 0.5, strength
    d = pick(DISCOUNTS, [float((n_t * _log_rising(strength, x, t_of)).sum() + (n_dishes * _stirling(float(x))[dish_c, dish_t]).sum()) for x in DISCOUNTS])
    return d, pick(STRENGTHS, [float((n_t * _log_rising(x, d, t_of)).sum() - (n_c * _log_rising(x, 1.0, c_of)).sum()) for x in STRENGTHS])


class Bucket:
    """All events of a range of contexts: pairs (word before, word) and triples of the training events, and what is asked of each event."""

    def __init__(self, blobs: list[bytes]):
        parts = [unpacked(b) for b in blobs]
        words = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        self.words, number = _numbered_ascending(np.concatenate(words))
        offsets = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        w, b1, b2 = (np.concatenate([number[o : o + len(own)][p[k].astype(np.int64)] for p, o, own in zip(parts, offsets, words, strict=False)]) for k in (1, 2, 3))
        self.docs = [np.cumsum(p[4], dtype=np.uint64).astype(np.int64) for p in parts]
        trained = ~np.concatenate([p[5] for p in parts]).astype(bool)
        del parts, words
        self.word, n = w, len(self.words)
        self.count = np.bincount(w[trained], minlength=n)
        self.is_word = np.bincount(w, minlength=n) > 0
        b1 = b1.astype(np.int64)
        # Pairs, triples and the restaurants of triples, also of those that only held-out events ask for: these have no customers.
        contexts, restaurant3 = _numbered(b2.astype(np.int64) * n + b1)
        pair_keys, self.pair = _numbered(b1 * n + w)
        triple_keys, self.triple = _numbered(restaurant3.astype(np.int64) * n + w)
        self.of2, self.word_of = pair_keys // n, pair_keys % n
        self.of3 = triple_keys // n
        self.pair_of = np.zeros(len(triple_keys), np.int32)
        self.pair_of[self.triple] = self.pair
        self.c3 = np.bincount(self.triple[trained], minlength=len(triple_keys))
        self.customers3 = np.bincount(restaurant3[trained], minlength=len(contexts))
        # Dishes of one customer have one table; what may have more is drawn anew in each sweep.
        self.some3 = np.flatnonzero(self.c3 > 1)
        one = self.c3 > 0
        self.least_tables3 = np.bincount(self.of3[one], minlength=len(contexts))
        self.least_c2 = np.bincount(self.pair_of[one], minlength=len(pair_keys))
        more = self.least_c2 > 1
        more[self.pair_of[self.some3]] = True
        self.some2 = np.flatnonzero(more)
        self.seen = np.bincount(self.word_of[self.least_c2 > 0], minlength=n)

    def sweeps(self, seed: tuple[int, ...], p1: np.ndarray, sweeps: int) -> Iterator[tuple[np.ndarray, Callable[[], np.ndarray]]]:
        """After each sweep the tables of pairs in the word before's restaurants, and a function for the probability of each triple."""
        draw = np.random.default_rng([7, *seed])
        some3, some2, n = self.some3, self.some2, len(self.words)
        c3, of3, pair_of = self.c3[some3], self.of3[some3], self.pair_of[some3]
        of2, parent2 = self.of2[some2], p1[self.word_of[some2]]
        is_open = self.customers3 > 0
        t3, c2, t2 = np.ones(len(some3), np.int64), self.least_c2, np.minimum(self.least_c2, 1)
        tables3 = self.least_tables3
        customers2, tables2 = (np.bincount(self.of2, x, minlength=n).astype(np.int64) for x in (c2, t2))
        d2, d3, s2, s3 = 0.7, 0.8, 1.0, 1.0
        for _ in range(sweeps):
            own = self.of2[pair_of]
            p2 = self._below(c2[pair_of], t2[pair_of], d2, s2, customers2[own], tables2[own], p1[self.word_of[pair_of]])
            t3 = seat(c3, (s3 + d3 * tables3[of3]) * p2, d3, draw)
            tables3 = self.least_tables3 + np.bincount(of3, t3 - 1, minlength=len(tables3)).astype(np.int64)
            c2 = self.least_c2 + np.bincount(pair_of, t3 - 1, minlength=len(c2)).astype(np.int64)
            t2 = np.minimum(c2, 1)
            t2[some2] = seat(c2[some2], (s2 + d2 * tables2[of2]) * parent2, d2, draw)
            customers2, tables2 = (np.bincount(self.of2, x, minlength=n).astype(np.int64) for x in (c2, t2))
            d3, s3 = resample(c3, t3, self.customers3[is_open], tables3[is_open], s3, draw)
            open2 = customers2 > 0
            d2, s2 = resample(c2[some2], t2[some2], customers2[open2], tables2[open2], s2, draw)

            def asked(c2=c2, t2=t2, t3=t3, tables3=tables3, customers2=customers2, tables2=tables2, d2=d2, d3=d3, s2=s2, s3=s3) -> np.ndarray:
                p2 = self._below(c2, t2, d2, s2, customers2[self.of2], tables2[self.of2], p1[self.word_of])
                every = np.minimum(self.c3, 1)
                every[some3] = t3
                return self._below(self.c3, every, d3, s3, self.customers3[self.of3], tables3[self.of3], p2[self.pair_of])

            yield t2, asked

    @staticmethod
    def _below(c: np.ndarray, t: np.ndarray, d: float, s: float, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (c - d * t + (s + d * tables) * parent) / (s + customers)


def _ranges(words: np.ndarray, ranges: int) -> np.ndarray:
    """Where the words of each of `ranges` equal parts of the hashes begin, and the end."""
    return np.append(np.searchsorted(words, np.arange(ranges, dtype=np.uint64) * np.uint64(2 ** (8 * WORD_BYTES) // ranges)), len(words))


_WORDS = "range long, bucket long, blob binary"


def _tables(ranges: int, sweeps: int):
    """For each range of words the bucket's words with their tables and training counts, after sweeps with the bucket's own counts as parent."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"range": [], "bucket": [], "blob": []})
        b = Bucket(part.sort_values("block")["blob"].tolist())
        for t2, _ in b.sweeps((0, key[0]), (b.seen + 0.5) / (b.seen + 0.5).sum(), sweeps):
            pass
        t1 = np.bincount(b.word_of, t2, minlength=len(b.words)).astype(np.int64)
        use = np.flatnonzero(b.is_word)
        cuts = _ranges(b.words[use], ranges)
        rows = [(r, key[0], packed(_ascending(b.words[x]), t1[x], b.count[x])) for r in range(ranges) if len(x := use[cuts[r] : cuts[r + 1]])]
        return pd.DataFrame(rows, columns=["range", "bucket", "blob"])

    return run


_PARENT = "bucket long, range long, blob binary, customers long, tables long, vocabulary long, tokens long, discount double"


def _parent(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Seats the restaurant over all words for a range of them: each bucket gets its words' customers, tables and training counts.

    A new table's weight is that of one table a word, (strength + discount * V) / (V + 1): the discount, nearly."""
    parts = [unpacked(b) for b in part["blob"]]
    each = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    words, at = _numbered(np.concatenate(each))
    c = np.bincount(at, np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(words)).astype(np.int64)
    count = np.bincount(at, np.concatenate([p[2] for p in parts]).astype(np.float64), minlength=len(words)).astype(np.int64)
    draw = np.random.default_rng([7, 1, key[0]])
    d, t = 0.5, np.minimum(c, 1)
    some = c > 0
    for _ in range(FIRST + BURN_IN):
        t[some] = seat(c[some], np.full(int(some.sum()), d), d, draw)
        d, _ = resample(c[some], t[some], c[some].sum(keepdims=True), t[some].sum(keepdims=True), 1.0, draw)
    ends = np.cumsum([len(w) for w in each])[:-1]
    out = pd.DataFrame({"bucket": part["bucket"], "range": key[0], "blob": [packed(*x) for x in zip(*(np.split(v[at], ends) for v in (c, t, count)), strict=True)]})
    for name, value in (("customers", c.sum()), ("tables", t.sum()), ("vocabulary", some.sum()), ("tokens", count.sum()), ("discount", d * t.sum())):
        out[name] = [value] + [0] * (len(out) - 1)
    return out


_SUMS = "block long, bucket long, blob binary, tokens long, vocabulary long"
#: A bucket's sums over a document travel as whole numbers of these parts: within 1e-5 and 2e-9 of the figures.
SCORE_UNITS, BASE_UNITS = 2.0**16, 2.0**28


def _answers(burn_in: int, samples: int):
    """Sums over the events of each document in a bucket: log10 probability, log10(count + 1) and known tokens."""

    def run(key: tuple, part: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0 or not len(part):
            return part.assign(tokens=0, vocabulary=0)
        part = part.sort_values("block")
        b = Bucket(part["blob"].tolist())
        parent = parent.sort_values("range")
        customers, tables, vocabulary, tokens, discount = (parent[f"all_{x}"].iloc[0] for x in ("customers", "tables", "vocabulary", "tokens", "discount"))
        d = discount / max(tables, 1)
        use = np.flatnonzero(b.is_word)
        c1, t1, count = (np.zeros(len(b.words)) for _ in range(3))
        for k, x in enumerate((c1, t1, count)):
            x[use] = np.concatenate([unpacked(blob)[k] for blob in parent["blob"]]).astype(np.float64)
        p1 = np.maximum(c1 - d * t1, 0) / (1.0 + customers) + (1.0 + d * tables) / (1.0 + customers) / (vocabulary + 1)
        total = np.zeros(len(b.c3))
        for k, (_, p) in enumerate(b.sweeps((2, key[0]), p1, burn_in + samples)):
            if k >= burn_in:
                total += p()
        logs = np.log10(total / samples)[b.triple]
        base, known = np.log10(count + 1)[b.word], (count > 0)[b.word]
        rows, at = [], 0
        for block, docs in zip(part["block"], b.docs, strict=True):
            x = slice(at, at + len(docs))
            at += len(docs)
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            add = lambda v, first=first, x=x: np.add.reduceat(v[x], first)
            sums = packed(_ascending(docs[first]), add(known.astype(np.int64)), np.rint(add(logs) * -SCORE_UNITS), np.rint(add(base) * BASE_UNITS))
            rows.append((block, key[0], sums, tokens, vocabulary))
        return pd.DataFrame(rows, columns=["block", "bucket", "blob", "tokens", "vocabulary"])

    return run


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    whole = part["bucket"] < 0
    ids, null, held, lengths = unpacked(part.loc[whole, "blob"].iloc[0])
    score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    rest = part[~whole].sort_values("bucket")
    for blob in rest["blob"]:
        docs, k, s, b = unpacked(blob)
        docs = np.cumsum(docs, dtype=np.uint64).astype(np.int64)
        score[docs] -= s / SCORE_UNITS
        base[docs] += b / BASE_UNITS
        known[docs] += k.astype(np.int64)
    n, v = int(rest["tokens"].max()), int(rest["vocabulary"].max())
    lengths = lengths.astype(np.int64)
    doc_id = pd.array(ids.view(np.int64), dtype="Int64").copy()
    doc_id[null.astype(bool)] = pd.NA
    return pd.DataFrame({"doc_id": doc_id, "held_out": held.astype(bool), "n_tokens": lengths, "n_known": known, "train_tokens": n, "base_score": base - lengths * math.log10(n + v + 1), "score": score, "perplexity": 10 ** np.minimum(-score / lengths, 300)})


def layout_of(slim: DataFrame) -> Layout:
    """Buckets for about BUCKET_TOKENS tokens each (estimated from the bytes of the texts), and the parts of words before that hold
    more than half as many; those words, at most four a bucket, go through the driver and to all tasks."""
    size = slim.agg(F.sum(F.octet_length("text") / 6 + 1)).first()[0] or 1
    buckets = math.ceil(size / BUCKET_TOKENS)
    counts = slim.mapInArrow(_frequent(BUCKET_TOKENS / 8 / size), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    hot = {int(r["word"]): 2 * int(r["n"]) // BUCKET_TOKENS for r in counts.where(F.col("n") >= BUCKET_TOKENS).collect()}
    return Layout(buckets, hot)


def score(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 probability) and perplexity of every text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    layout = layout_of(slim)
    tasks = max(layout.buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events = slim.mapInArrow(_events(layout), _EVENTS).repartition(tasks, "bucket")
    words = events.groupBy("bucket").applyInPandas(_tables(layout.buckets, FIRST), _WORDS)
    parent = words.groupBy("range").applyInPandas(_parent, _PARENT)
    figures = ("customers", "tables", "vocabulary", "tokens", "discount")
    whole = parent.agg(*(F.sum(x).alias(f"all_{x}") for x in figures))  # one row
    parent = parent.drop(*figures).crossJoin(F.broadcast(whole))
    sums = events.groupBy("bucket").cogroup(parent.groupBy("bucket")).applyInPandas(_answers(burn_in, samples), _SUMS)
    return sums.groupBy("block").applyInPandas(_score, _SCORE)
