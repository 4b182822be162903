import functools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from rulefact.llm.common import Texts, encode, shingle_sets, slices

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abAB é\t\n\x0b\x0c\r \u3000x")), st.text(max_size=30)), max_size=8)


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode("utf-8", "surrogatepass"))


@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_words_and_shingles_match_plain_python(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    t = Texts(pa.array(texts, pa.string()))
    starts, ends, first = t.words()
    for i, text in enumerate(texts):
        got = [t.data[a:b].tobytes() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert got == (text or "").encode().split(b" ") or got == (text or "").encode().split()
    for size in (1, 2, 5):
        values, at = shingle_sets(t, size)
        for i, text in enumerate(texts):
            w = lowered(text).split()
            want = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
            assert at[i + 1] - at[i] == len(want)
            assert len(set(values[at[i] : at[i + 1]].tolist())) == len(want)


def test_equal_words_hash_alike_wherever_they_stand():
    t = Texts(pa.array(["alpha beta", "Beta  alpha", None, ""]))
    h, first = t.word_hashes(lower=True)
    assert list(first) == [0, 2, 4, 4, 4]
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


def test_slices_keep_whole_texts():
    column = pa.array(["x" * 10] * 7 + ["y" * 100, None, ""])
    parts = list(slices(column, 25))
    assert [p for _, part in parts for p in part.to_pylist()] == [None if x is None else x.encode() for x in column.to_pylist()]
    assert [at for at, _ in parts] == list(np.cumsum([0] + [len(p) for _, p in parts])[:-1])


def test_encode_equals_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", "Hello world's  end\n\n x", "a <|endoftext|> b", "é　 1234 %%%", " " * 70_000 + "z"]:
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids
    assert encode(None).tolist() == []
    # Beyond what the fast splitter can take, also with a vocabulary that is named.
    for path in (None, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        text = "a b" + " " * 1_200_000 + "z <|endoftext|> é"
        assert encode(text, path).tolist() == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encode_equals_the_tokenizer_file_on_any_text(text):
    assert encode(text).tolist() == slow_tokenizer().encode(text, add_special_tokens=False).ids


@functools.cache
def slow_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encode_equals_the_tokenizer_file_on_a_whole_table():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    want = slow_tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(encode(t).tolist() == w.ids for t, w in zip(texts, want, strict=True))
