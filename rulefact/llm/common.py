"""Helpers shared by the corpus operators: table access, word splitting on Arrow buffers, token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rulefact.sources.durable import durable as stored  # noqa: F401  what every operator cuts its lineage with

#: A word is a run of bytes other than these; UTF-8 never uses them inside a longer character.
WHITE = b" \t\n\x0b\x0c\r"
#: The same class for Spark's regular expressions and for DuckDB's.
WORD = r"[^\x20\x09-\x0D]+"

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or that with underscores before it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        step = np.full(max(n, 1024), _BASE, np.uint64)
        step[0] = 1
        _POWERS = np.cumprod(step, dtype=np.uint64)
    return _POWERS


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _SAME, chunk: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each run data[start:end] after mapping its bytes; runs ascend and are not empty."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, "right")))
        s, e = starts[at:to], ends[at:to]
        lengths = e - s
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        value = table[data[inside + np.repeat(s, lengths)]].astype(np.uint64) + np.uint64(1)
        out[at:to] = np.add.reduceat(value * _powers(int(lengths.max()))[inside], first) + lengths.astype(np.uint64)
        at = to
    return mix(out)


class Texts:
    """The texts of an Arrow array as one byte buffer; nulls count as empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.offsets = offsets - offsets[0]
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.n = len(column)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and for each text the index of its first word (one entry more at the end)."""
        solid = np.zeros(len(self.data) + 2, bool)
        solid[1:-1] = ~_IS_WHITE[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offsets] = True
        starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1])) if len(self.data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1 if len(self.data) else np.zeros(0, np.int64)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word (A-Z lowered if asked) and each text's first word."""
        starts, ends, first = self.words()
        return hash_runs(self.data, starts, ends, _LOWER if lower else _SAME), first


def slices(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, pa.Array]]:
    """The column in runs of about `most` bytes of text (one text at least), each with its first index."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of `size` words of each text: hashes, ascending by text, and each text's first index.

    A text of fewer words, one at least, has one shingle: the whole sequence.
    """
    words, first = texts.word_hashes(lower=True)
    counts = np.diff(first)
    total = len(words)
    rolled = np.zeros(total, np.uint64)
    left = np.repeat(first[1:], counts) - np.arange(total)  # words from here to the text's end
    for k in range(size):
        part = np.zeros(total, np.uint64)
        part[: max(total - k, 0)] = words[k:]
        rolled = np.where(left > k, mix(rolled * np.uint64(_BASE) + part), rolled)
    short = np.repeat(counts < size, counts)
    is_first = np.zeros(total, bool)
    is_first[first[:-1][counts > 0]] = True
    use = (left >= size) | (short & is_first)
    owner = np.repeat(np.arange(texts.n), counts)[use]
    value = rolled[use]
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(texts.n + 1))


_ENCODER = None


def encoder(path: str | None = None):
    """The byte-level BPE of byte_bpe_50k.json through its rank file, which gives the same ids; `path` names another rank file."""
    global _ENCODER
    if _ENCODER is None or _ENCODER[0] != path:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODER = path, tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _ENCODER[1]


def _piece_by_piece(encoding, text: str) -> list[int]:
    """The ids of a text whose blanks are too many for the library's own splitter: split here by the same pattern."""
    import regex

    ids: list[int] = []
    for k, part in enumerate(text.split("<|endoftext|>")):
        if k:
            ids.append(encoding.eot_token)
        for piece in regex.finditer(encoding._pat_str, part):
            ids += encoding._encode_single_piece(piece[0])
    return ids


def encode(text: str | None, path: str | None = None) -> np.ndarray:
    """Token ids of a text as unsigned 32-bit numbers; null: none."""
    if not text:
        return np.zeros(0, "<u4")
    encoding = encoder(path)
    try:
        return np.asarray(encoding.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
    except ValueError:  # the splitter's stack ends at about a million blanks in a row
        return np.array(_piece_by_piece(encoding, text), dtype="<u4")
