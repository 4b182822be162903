"""op 11 against the sentencepiece library: ids and decoded texts, random and odd texts, odd tables."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rulefact.llm import pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def odd_texts():
    r = random.Random(6)
    table, sp = pieces.load()
    out = ["", " ", "  ", "▁", " ▁a", "a\x00b", "\r\n\t\n", "éé", "ﬁ①", "<s></s><0x41><unk>", "日本語のテキスト", "👩‍👩‍👧", " " * 5000, "=" * 3001, "ab" * 4000]
    for k in range(1500):
        n = r.randint(0, 50)
        out.append([
            lambda: "".join(r.choice(" ▁ab \n\t") for _ in range(n)),
            lambda: "".join(chr(r.randint(0, 0x10FFFF)) for _ in range(n)).encode("utf-8", "ignore").decode(),
            lambda: "".join(sp.id_to_piece(r.randint(259, 31_999)) for _ in range(n // 4)),
            lambda: "".join(r.choice("aab eetth0123 .,éñ日") for _ in range(n)),
        ][k % 4]())
    return out


def test_ids_equal_the_librarys(library):
    table, _ = pieces.load()
    for text in odd_texts():
        assert numbers(table.encode(text)) == library.encode(text, add_bos=True, add_eos=True), repr(text)


def test_every_prefix_has_the_last_token_of_its_own_encoding():
    table, _ = pieces.load()
    for text in ("unbelievably", "▁▁▁▁internationalisation", "aaaaaaaaa", "▁keyboards"):
        last = table.last_pieces(text)
        assert all(last[n] == table.tokens(text[:n])[-1] for n in range(1, len(text) + 1))


def test_full_memories_change_nothing(library):
    table, _ = pieces.load()
    small = pieces.Recent(table._cut_ids, 3)
    before, table.cut_ids = table.cut_ids, small
    try:
        text = "one two three four five six seven one two"
        assert numbers(table.encode(text)) == library.encode(text, add_bos=True, add_eos=True) and len(small) <= 3
    finally:
        table.cut_ids = before


def test_other_models_are_refused(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "_LOADED", {})
    monkeypatch.setattr(pieces.PieceTable, "encode", lambda self, text: b"")
    with pytest.raises(ValueError):
        pieces.load(path)


def test_frames(spark, library):
    texts = [None, *odd_texts()[:60], "same", "same", "word " * 40_000]
    rows = [(None if k % 9 == 4 else k // 2, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1)).repartition(3)
    got = pieces.encode(docs, decoded=True)
    want = [(i, tuple(library.encode(t or "", add_bos=True, add_eos=True)), library.decode(library.encode(t or "", add_bos=True, add_eos=True))) for i, t, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, tuple(numbers(r.ids)), r.decoded) for r in got.collect()), key=key) == sorted(want, key=key)
    back = pieces.decode(pieces.encode(docs))
    assert sorted((str(r.doc_id), r.decoded) for r in back.collect()) == sorted((str(i), d) for i, _, d in want)
    assert pieces.encode(docs.limit(0), decoded=True).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        want[d.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = queries.op11_piece_ids(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(docs)
