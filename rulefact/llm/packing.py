"""Hierarchical packing of documents into training sequences of several lengths.

Tiers are the powers of two from the longest window (1024) down to 128. Whole windows of a document stand alone in the longest
tier. What remains of it is routed to the smallest tier that holds it. Each tier opens a window for its longest pieces and
fills the gap from the shorter tiers, best fit first; a piece is cut where nothing fits whole. A window that the pool cannot
fill is split into windows of powers of two, so no sequence is padded. Windows of a tier are dealt to step groups of equal
tokens so that the squared lengths of the groups are balanced.

Each task packs what it reads: no shuffle, memory bounded by the pool (POOL pieces of less than one window).
Defined cases: a null or empty text is one token (the end id); repeated rows and null doc_ids are packed like others; a very long
text is encoded whole and cut into windows at once; ties in length go to the piece that waits shortest; other columns are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.llm.common import encode

WINDOW, SHORTEST, END, POOL, STEP = 1024, 128, 0, 4096, 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long"


class Packer:
    """Pieces wait in the pool by length; a bit of `mask` tells which lengths are there, so the best fit is found at once."""

    def __init__(self, number: int, window: int = WINDOW, shortest: int = SHORTEST, step: int = STEP):
        self.window, self.step = window, step
        self.tiers = [t for k in range(window.bit_length()) if shortest <= (t := window >> k)]
        self.pool: list[list[tuple]] = [[] for _ in range(window + 1)]
        self.mask, self.waiting = 0, 0
        self.next_sequence = self.next_group = number << 40
        self.columns: list[list] = [[] for _ in SCHEMA.split(", ")]
        self.dealt: list[tuple[int, int, list[tuple]]] = []  # tier, squared lengths, pieces of a finished window

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total // self.window * self.window
        for start in range(0, whole, self.window):
            self._window([(doc_id, start, ids[start : start + self.window], total)])
        if whole < total:
            self._wait((doc_id, whole, ids[whole:].copy(), total))
        if self.waiting >= POOL:
            self.pack()

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pool[n].append(piece)
        self.mask |= 1 << n
        self.waiting += 1

    def _take(self, most: int) -> tuple | None:
        """The longest waiting piece of at most `most` tokens."""
        n = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n <= 0:
            return None
        piece = self.pool[n].pop()
        self.waiting -= 1
        if not self.pool[n]:
            self.mask &= ~(1 << n)
        return piece

    def _cut(self, piece: tuple, n: int) -> tuple:
        """The first n tokens of a piece; the rest waits on."""
        doc_id, start, ids, total = piece
        self._wait((doc_id, start + n, ids[n:], total))
        return doc_id, start, ids[:n], total

    def pack(self) -> None:
        for tier in self.tiers:
            low = tier // 2 if tier > self.tiers[-1] else 0
            while (first := self._take(tier)) is not None:
                if len(first[2]) <= low:  # belongs to a shorter tier
                    self._wait(first)
                    break
                parts, gap = [first], tier - len(first[2])
                while gap:
                    piece = self._take(gap)
                    if piece is None:  # nothing fits whole: cut the shortest that waits
                        if not self.mask:
                            break
                        piece = self._cut(self._take((self.mask & -self.mask).bit_length() - 1), gap)
                    parts.append(piece)
                    gap -= len(piece[2])
                self._window(parts)
        self._deal()

    def _window(self, parts: list[tuple]) -> None:
        """Closes a window; one that is no power of two long is split into windows that are."""
        total = sum(len(p[2]) for p in parts)
        while total:
            size = 1 << (total.bit_length() - 1)
            inside, left = [], size
            while left:
                doc_id, start, ids, n = parts.pop(0)
                if len(ids) > left:
                    parts.insert(0, (doc_id, start + left, ids[left:], n))
                    ids = ids[:left]
                inside.append((doc_id, start, ids, n))
                left -= len(ids)
            self.dealt.append((size, sum(len(p[2]) ** 2 for p in inside), inside))
            total -= size
        if len(self.dealt) >= POOL:
            self._deal()

    def _deal(self) -> None:
        """Windows of one tier, heaviest first, go back and forth over the tier's step groups."""
        self.dealt.sort(key=lambda x: (-x[0], -x[1]))
        at = 0
        while at < len(self.dealt):
            tier = self.dealt[at][0]
            to = at
            while to < len(self.dealt) and self.dealt[to][0] == tier:
                to += 1
            groups = -(-(to - at) * tier // (self.window * self.step))
            for k in range(at, to):
                turn, place = divmod(k - at, groups)
                self._emit(tier, self.next_group + (groups - 1 - place if turn % 2 else place), self.dealt[k][2])
            self.next_group += groups
            at = to
        self.dealt = []

    def _emit(self, tier: int, group: int, parts: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in parts:
            for column, x in zip(self.columns, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_sequence, offset, tier, tier, group), strict=True):
                column.append(x)
            offset += len(ids)
        self.next_sequence += 1

    def ready(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if "int" in c else pa.int64()) for x, c in zip(self.columns, SCHEMA.split(", "), strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
        self.columns = [[] for _ in self.columns]
        return out


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), window)
        end = np.array([END], "<u4")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                packer.add(doc_id, np.concatenate((encode(text.as_py(), vocabulary), end)))
                if len(packer.columns[0]) >= 20_000:
                    yield packer.ready()
        packer.pack()
        yield packer.ready()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
