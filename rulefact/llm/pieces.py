"""SentencePiece (BPE) ids by a table of prefixes, and back.

Merging by score never undoes a boundary it has kept, so the ids of a prefix of a text are a prefix of the text's ids up to its
last token, and every prefix has one last token. It is found from left to right: an Aho-Corasick automaton gives the pieces that
end at a place; of these the one is right whose start is the end of a prefix with a last token that may stand before it (a pair
may stand together if merging their characters never joins across the two). Each prefix stores its last token; ids are then read
off backwards. Time is in proportion to the text, also for runs without a blank.

A text is cut first between characters that no piece has beside each other, as before a blank or a comma: no merge reaches
across. Cuts are independent, so the ids of recent ones are kept in a bounded memory of the worker.

Defined cases: a null or empty text has the begin and end ids only and decodes to an empty text; blanks and the blank mark U+2581
are the same to the library, and decode to blanks; characters without a piece become the ids of their bytes; very long texts are
encoded whole; null doc_ids and repeated rows are rows like others; other columns are not read, whatever their names; an empty
table gives an empty result. Models other than BPE with byte fallback, identity normalizer and a blank in front are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.llm.common import slices

BLANK = "▁"
#: Entries that a worker's memories of cuts and of pairs hold before they are emptied.
REMEMBER = 1 << 19

#: Texts on which table and library must agree when a model is loaded.
PROBES = ["", " a  b \n", "ﬁ① The unbelievably internationalised keyboard's 1234 keys", "aaaaaaa======    \t"]

History = list[tuple[float, str, str]]


class Recent(dict):
    """A memory of what `make` gives; emptied when it is full."""

    def __init__(self, make, most: int = REMEMBER):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.make(key)
        return found


class PieceTable:
    """A vocabulary with its automaton. `cost` of a piece: the lower, the earlier it is merged."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], begin: int, end: int):
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.cost = {p: -score for p, (_, score) in pieces.items() if len(p) > 1}
        self.byte_ids, self.begin, self.end = byte_ids, begin, end
        self.histories: dict[str, History] = {}
        self.automaton = ahocorasick.Automaton()
        for p in pieces:
            if len(p) == 1 or self.history(p)[-1:] and self.history(p)[-1][1] == p:  # others never come about by merging
                self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        known = sorted({c for p in pieces for c in p})
        self.character = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.character[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.beside = np.zeros((len(known) + 1, len(known) + 1), bool)  # characters that stand beside each other in a piece
        for p in pieces:
            at = self.character[[ord(c) for c in p]]
            self.beside[at[:-1], at[1:]] = True
        self.stand_together = Recent(self._stand_together)
        self.cut_ids = Recent(self._cut_ids)

    def history(self, piece: str) -> History:
        """The merges of a piece alone, best first, ties from the left: cost, and the first and last symbol after each."""
        if piece not in self.histories:
            symbols, steps = list(piece), []
            while len(symbols) > 1:
                best, at = min((self.cost.get(a + b, math.inf), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])))
                if best == math.inf:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                steps.append((best, symbols[0], symbols[-1]))
            self.histories[piece] = steps
        return self.histories[piece]

    def _stand_together(self, pair: tuple[str, str]) -> bool:
        """Whether merging the characters of both never joins across them: both histories run side by side, cheaper step first."""
        left, right = self.history(pair[0]), self.history(pair[1])
        x, y, i, j = pair[0][-1], pair[1][0], 0, 0
        while True:
            across = self.cost.get(x + y, math.inf)
            a = left[i][0] if i < len(left) else math.inf
            b = right[j][0] if j < len(right) else math.inf
            if across < a and across <= b:  # of equal costs the leftmost goes first
                return False
            if a == b == math.inf:
                return True
            if a <= b:
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1

    def last_pieces(self, text: str) -> list[str]:
        """For each prefix, by its length, the last token; the empty one first."""
        last = ["", *text]  # a character without a piece stands alone
        stand_together, found = self.stand_together, -1
        for at, (length, piece) in self.automaton.iter(text):
            if at != found and (at + 1 == length or stand_together[last[at + 1 - length], piece]):
                last[at + 1] = piece
                found = at
        return last

    def cuts(self, text: str) -> list[str]:
        """The text, cut between all characters that no piece has beside each other."""
        c = self.character[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        ends = (np.flatnonzero(~self.beside[c[:-1], c[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])] if text else []

    def tokens(self, text: str) -> list[str]:
        last, at, out = self.last_pieces(text), len(text), []
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _cut_ids(self, text: str) -> bytes:
        ids: list[int] = []
        for token in self.tokens(text):
            if token in self.ids:
                ids.append(self.ids[token])
            else:
                ids += (self.byte_ids[b] for b in token.encode())
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit numbers."""
        marked = BLANK + text.replace(" ", BLANK) if text else ""
        return np.uint32(self.begin).tobytes() + b"".join(map(self.cut_ids.__getitem__, self.cuts(marked))) + np.uint32(self.end).tobytes()


_LOADED: dict[str, tuple] = {}


def load(model: str | None = None) -> tuple:
    """The table of a model file (default: piece_bpe_32k.model) and the library's processor, once in a process."""
    import public_tokenizers
    import sentencepiece

    path = model or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _LOADED:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        table = PieceTable(pieces, byte_ids, sp.bos_id(), sp.eos_id())
        same = all(table.encode(x) == np.array(sp.encode(x, add_bos=True, add_eos=True), "<u4").tobytes() for x in PROBES)
        if not same or any(map(sp.is_unused, every)) or not all(map(sp.is_byte, byte_ids)):
            raise ValueError(f"{path}: not a BPE model with byte fallback, identity normalizer and a blank in front")
        _LOADED[path] = table, sp
    return _LOADED[path]


def encode(docs: DataFrame, model: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit, begin and end included) of every text; with `decoded`, the text they give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sp = load(model)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids = [table.encode(x.as_py().decode() if x.is_valid else None) for x in texts]
                columns = [batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([sp.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, decoded of rows with doc_id and ids as encode() returns them; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sp = load(model)
        for batch in batches:
            texts = [sp.decode(np.frombuffer(x.as_py(), "<u4").tolist()) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
