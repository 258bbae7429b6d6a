"""SentencePiece encoding and decoding with merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs, ordered by the score of the piece they would
form and then from left to right, and merges until no pair is a piece. A pair that crosses into a
word mark or touches a character without pieces can never merge, so a text falls into segments that
are encoded on their own; frequent segments are remembered. The vocabulary is read from the model
file; its merges are done here and tested against the library.
"""

from __future__ import annotations

import re
from array import array
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.batches import Remembered, per_chunk

MARK = "▁"
#: Characters up to which a segment keeps its agenda in a list.
SHORT = 48
NEVER = float("inf")


class MergeVocabulary:
    """A merge-type vocabulary without normalisation, with a mark before the text and byte pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = processor.get_piece_size()
        surface: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.order: dict[str, float] = {}
        self.bytes = [0] * 256
        for i in range(size):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                surface.append(bytes([value]))
            elif processor.is_control(i) or processor.is_unknown(i):
                surface.append(b"")
            else:
                self.ids[piece] = i
                self.order[piece] = -processor.get_score(i)
                surface.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark behind another character; segments would not be independent")
        self.surface = pa.array(surface, pa.large_binary())
        # A line end without a piece of its own bounds segments too, which makes them recur more often.
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        self.segments = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|{alone}" if alone else ""))
        self.remembered = Remembered(self._encoded)

    def merge(self, segment: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece."""
        return self._merge_short(segment) if len(segment) <= SHORT else self._merge_long(segment)

    def _merge_short(self, segment: str) -> list[str]:
        """The agenda as a plain list, one entry per adjacent pair: for a word, searching it beats keeping a heap."""
        symbols = list(segment)
        order = self.order.get
        agenda = [order(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            merged = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = order(merged + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = order(symbols[i - 1] + merged, NEVER)
        return symbols

    def _merge_long(self, segment: str) -> list[str]:
        """The agenda as a heap."""
        symbols = list(segment)
        n = len(symbols)
        order = self.order.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            rank = order(symbols[i] + symbols[i + 1])
            if rank is not None:
                agenda.append((rank, i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbols[left], symbols[right]
            # A pair is stale once one of its symbols was merged away or has grown.
            if not a or not b or len(a) + len(b) != size or after[left] != right:
                continue
            symbols[left], symbols[right] = merged, _ = a + b, ""
            following = after[left] = after[right]
            if following < n:
                before[following] = left
                rank = order(merged + symbols[following])
                if rank is not None:
                    heappush(agenda, (rank, left, following, size + len(symbols[following])))
            previous = before[left]
            if previous >= 0:
                rank = order(symbols[previous] + merged)
                if rank is not None:
                    heappush(agenda, (rank, previous, left, size + len(symbols[previous])))
        return [s for s in symbols if s]

    def _encoded(self, segment: str) -> bytes:
        found = array("i")
        for symbol in self.merge(segment):
            i = self.ids.get(symbol)
            if i is None:
                found.extend(self.bytes[b] for b in symbol.encode())
            else:
                found.append(i)
        return found.tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        return np.frombuffer(b"".join(map(self.remembered.__getitem__, self.segments.findall(marked))), np.int32)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids: pieces joined, byte pieces read as UTF-8, the first mark dropped."""
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        taken = self.surface.take(pa.array(flat))
        starts = np.frombuffer(taken.buffers()[1], np.int64)
        joined = taken.buffers()[2].to_pybytes() if len(flat) else b""
        ends = starts[np.cumsum([0, *map(len, ids)])]
        texts = [joined[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@cache
def vocabulary(model_file: str) -> MergeVocabulary:
    """One vocabulary per process."""
    return MergeVocabulary(model_file)


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id``, the ``ids`` of each text and the text ``decoded`` from them, one row per row of ``docs``.

    A null or empty text has no ids. Repeated rows and null ids of documents stay; other columns are
    not looked at. Texts of any length are encoded whole.
    """

    def make():
        held = vocabulary(model_file)

        def work(doc_ids, texts):
            ids = [held.encode(t) for t in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(held.decode(ids), pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )

        return work

    return per_chunk(docs, make, "doc_id bigint, ids array<int>, decoded string")


def digests(table: DataFrame) -> DataFrame:
    """Number of ids and the digests of ids and decoded text of ``encoded``."""
    return table.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
