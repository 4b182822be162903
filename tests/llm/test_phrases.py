"""op 13 against brute force, with tries that burst and spill all the time, hot words, odd texts and tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulefact.llm import phrases

SCHEMA = "doc_id long, text string, lang string, words string, n long"


def brute(rows, least, top, inside=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            longer = [q for q, b in c.items() if len(q) > len(p) and b >= least and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not longer:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocab = ["".join(r.choice("abéÀñZ") for _ in range(r.randint(1, 4))) for _ in range(60)]
    fixed = [" ".join(r.choice(vocab) for _ in range(r.randint(2, 6))) for _ in range(12)]
    text = lambda n: r.choice([" ", "  ", "\t"]).join(r.choice(fixed if r.random() < 0.5 else vocab) + r.choice(["", "", "", ",", ".", "\n", "!?"]) for _ in range(n))
    out = [(k, text(r.randint(0, 40)), ["en", "fr", None, "und"][k % 4], "x", 1) for k in range(300)]
    out += [(None, None, "en", None, None), (1, "", "fr", "x", 1), (2, " \t\n.,", "en", "x", 1), (3, text(3000), "en", "x", 1), (4, "a\x00b c d \x1c e", "en", "x", 1)]
    out += [(7, "the very same row of words", "de", "x", 1)] * 40 + [(8, "x" * 70_000 + " tail", "de", "x", 1)] * 2
    return out


def shown(df):
    return sorted(tuple(x) for x in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("memory", [{}, {"burst": 3, "most": 60}, {"bits": 8}])
def test_equals_brute_force(spark, rows, memory):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit("x")).repartition(3)
    assert shown(phrases.collocations(docs, least=4, top=50, **memory)) == brute(rows, 4, 50)


def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows[:3], SCHEMA)
    assert shown(phrases.collocations(docs.limit(0))) == []
    assert shown(phrases.collocations(docs, least=1, top=7)) == brute(rows[:3], 1, 7)
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert shown(phrases.collocations(nulls, least=1)) == []


def test_trie_counts_and_spills_in_order():
    r = random.Random(1)
    trie, want, got = phrases.HatTrie(burst=4), Counter(), Counter()
    for turn in range(40):
        k = r.randint(2, 4)
        some = Counter(tuple(r.randrange(1, 6) for _ in range(k)) for _ in range(50))
        want.update(some)
        keys = sorted(some)
        trie.add(np.array(keys, np.uint64).astype(">u8"), np.array([some[x] for x in keys]))
        if turn % 9 == 8 or turn == 39:
            for words, counts in trie.spill(0 if turn == 39 else trie.size // 2):
                keys = [tuple(map(int, w)) for w in words]
                assert keys == sorted(keys) and len(set(keys)) == len(keys)
                got.update(dict(zip(keys, counts.tolist())))
    assert got == want and trie.size == 0 and not trie.root


def test_merge_of_many_overlapping_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "CHUNK", 1)  # everything before a chunk leaves as soon as 64 phrases wait
    r, want, chunks = random.Random(3), Counter(), []
    ids = [r.randrange(1 << 64) for _ in range(40)]
    for _ in range(30):
        run = sorted({(r.choice(ids), r.choice(ids)) for _ in range(200)})
        want.update(run)
        for at in range(0, len(run), 7):
            words = np.array(run[at : at + 7], np.uint64).astype(">u8")
            chunks.append((0, "en", words[0].tobytes(), words.tobytes(), np.ones(len(words), np.int64).tobytes()))
    chunks.sort(key=lambda x: x[2])
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*chunks)], names=["bucket", "lang", "first", "keys", "counts"])
    out = [(tuple(w % (1 << 64) for w in row["words"]), row["n"]) for b in phrases._merged(1)(iter([batch])) for row in b.to_pylist()]
    assert len(out) == len(want) and dict(out) == want


def test_hot_prefixes_take_several_partitions():
    words = np.array([[7, k] for k in range(1000)] + [[k, 1] for k in range(8, 1008)], np.uint64)
    part = phrases.Parts(50, {7: 20}).of(words)
    assert len(set(part[:1000])) == 20 and (part >= 0).all() and (part < 50).all()
    assert len(set(phrases.Parts(50, {}).of(words)[:1000])) == 1


def test_word_ids_depend_on_seed_and_place():
    data, starts = np.frombuffer(b"ab ba AB ab", np.uint8), np.array([0, 3, 6, 9])
    ids = phrases._word_ids(data, starts, starts + 2, 0)
    assert ids[0] == ids[2] == ids[3] != ids[1] and ids[0] != phrases._word_ids(data, starts, starts + 2, 1)[0]
