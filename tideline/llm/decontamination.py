"""Benchmark decontamination with generalised suffix automata of test items.

A window is a number of consecutive words of an item, or all words of a shorter item. An automaton
holds every run of words of a block of items; a document streams through it and, at each word, the
longest run ending there that some item holds (its matching statistics) tells which windows end there.
Stretches whose neighbouring words follow each other in no item are never streamed: a run cannot
cross such a place, so the automaton would be back at single words there. Items come in blocks of bounded size,
and documents pass through one block after the other, carrying what was found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.automaton import SuffixAutomaton
from tideline.session import cut_lineage

#: Words of an item that stand in one automaton; a longer item is cut into pieces that overlap.
PIECE_WORDS = 20_000
#: Bytes of items in a block, about.
BLOCK_BYTES = 1 << 20
#: Bytes of documents taken at once.
CHUNK_BYTES = 4 << 20

# ASCII letters in lower case, digits and bytes beyond ASCII stay; all else separates words.
_TABLE = bytes(
    b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_SPAN = "array<struct<first:bigint,end:bigint>>"


def item_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_TABLE).split()


class ItemAutomaton:
    """All windows of a block of items: which of them end at a word of a document."""

    def __init__(self, items: Sequence[tuple[str | None, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        worded = [(i, [number(w, len(self.vocabulary)) for w in text.split()]) for i, text in items]
        worded = [(i, symbols) for i, symbols in worded if symbols]
        a = self.automaton = SuffixAutomaton()
        for owner, (_, symbols) in enumerate(worded):
            a.add(symbols, owner)
        order = sorted(range(1, len(a.length)), key=a.length.__getitem__)
        # The state of the last ``window`` words of a state's runs.
        self.top = list(range(len(a.length)))
        for v in order:
            if a.length[a.link[v]] >= window:
                self.top[v] = self.top[a.link[v]]
        self.full: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, set]]] = {}
        for item, symbols in worded:
            size = min(window, len(symbols))
            for state, run in a.matches(symbols):
                if run < size:
                    continue
                if size == window:
                    self.full.setdefault(self.top[state], set()).add(item)
                elif run == size:
                    held = dict(self.short.get(state, []))
                    held.setdefault(size, set()).add(item)
                    self.short[state] = sorted(held.items())
        # The nearest state above that ends with a whole short item.
        self.above = [0] * len(a.length)
        for v in order:
            up = a.link[v]
            self.above[v] = up if up in self.short else self.above[up]
        self.least = min((min(window, len(s)) for _, s in worded), default=window)
        # Neighbouring words of items, as sorted numbers.
        followed = [np.array(s, np.int64) for _, s in worded]
        codes = [s[:-1] * len(self.vocabulary) + s[1:] for s in followed]
        self.neighbours = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)

    def _stretches(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of stretches of words, each two neighbours of which stand so in some item."""
        known = symbols >= 0
        linked = np.zeros(len(symbols), bool)
        both = np.flatnonzero(known[:-1] & known[1:])
        if len(both) and len(self.neighbours):
            codes = symbols[both].astype(np.int64) * len(self.vocabulary) + symbols[both + 1]
            at = np.minimum(np.searchsorted(self.neighbours, codes), len(self.neighbours) - 1)
            linked[both] = self.neighbours[at] == codes
        starts = np.flatnonzero(known & ~np.concatenate([[False], linked[:-1]]))
        ends = np.flatnonzero(known & ~linked) + 1
        wide = ends - starts >= self.least
        return starts[wide], ends[wide]

    def occurrences(self, symbols: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """Start and end of every occurring window, with its items."""
        for start, stop in zip(*(x.tolist() for x in self._stretches(symbols))):
            for k, (state, run) in enumerate(self.automaton.matches(symbols[start:stop].tolist()), start + 1):
                if run >= self.window:
                    found = self.full.get(self.top[state])
                    if found:
                        yield k - self.window, k, found
                if self.short:
                    v = state if state in self.short else self.above[state]
                    while v:
                        for size, found in self.short[v]:
                            if size <= run:
                                yield k - size, k, found
                        v = self.above[v]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _pieces(benchmark: DataFrame, window: int, blocks: int) -> DataFrame:
    """Items as rows of block, id and words; long items in pieces that share ``window`` - 1 words."""
    rows = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = item_words(text.encode())
                for at in range(0, max(len(words) - window + 1, 1), PIECE_WORDS):
                    part = words[at : at + PIECE_WORDS + window - 1]
                    if part:
                        out.append((item, at, b" ".join(part)))
            columns = zip(*out) if out else ((), (), ())
            kinds = (pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "at", "words"])

    pieces = rows.mapInArrow(run, "item_id string, at bigint, words binary")
    return pieces.select(F.pmod(F.xxhash64("item_id", "at"), F.lit(blocks)).alias("block"), "item_id", "words")


def _through(held: DataFrame, items: list[tuple[str | None, bytes]], window: int) -> DataFrame:
    """Documents and what was found so far, after one more block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton(items, window)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                held_bytes, stop = 0, start
                while stop < batch.num_rows and (stop == start or held_bytes + sizes[stop] <= CHUNK_BYTES):
                    held_bytes += sizes[stop]
                    stop += 1
                yield _chunk(automaton, batch.slice(start, stop - start))
                start = stop

    return held.mapInArrow(run, held.schema)


def _chunk(automaton: ItemAutomaton, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    # One list of words for all texts; a word that no text holds stands before each of them.
    words = b" ".join(b"\x00 " + t.translate(_TABLE) for t in texts).split()
    symbols = np.fromiter(map(automaton.vocabulary.get, words, repeat(-1)), np.int32, len(words))
    marks = np.flatnonzero(np.fromiter(map(b"\x00".__eq__, words), bool, len(words)))
    counts = np.diff(np.append(marks, len(words))) - 1
    found: dict[int, tuple[list, set]] = {}
    for first, end, items in automaton.occurrences(symbols):
        row = int(np.searchsorted(marks, first, "right")) - 1
        spans, ids = found.setdefault(row, ([], set()))
        begin = first - int(marks[row]) - 1
        if spans and spans[-1][0] <= begin <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], begin + end - first))
        else:
            spans.append((begin, begin + end - first))
        ids |= items
    columns = dict(zip(batch.schema.names, batch.columns))
    if found:
        spans_so_far, items_so_far = columns["spans"].to_pylist(), columns["item_ids"].to_pylist()
        for row, (spans, ids) in found.items():
            whole = merged([(s["first"], s["end"]) for s in spans_so_far[row]] + spans)
            spans_so_far[row] = [{"first": a, "end": b} for a, b in whole]
            # An item without an id has windows but no name.
            items_so_far[row] = sorted({*items_so_far[row], *(i for i in ids if i is not None)})
        columns["spans"] = pa.array(spans_so_far, columns["spans"].type)
        columns["item_ids"] = pa.array(items_so_far, columns["item_ids"].type)
    columns["n_words"] = pa.array(counts, pa.int64())
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, keep_columns: bool) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` and ``item_ids``; of their columns the text and, by place, others on demand."""
    if window < 1:
        raise ValueError("a window has a word at least")
    kept = [F.col("doc_id")]
    if keep_columns:
        packed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
        kept = [F.struct(F.col("text").isNull().alias("no_text"), *packed).alias("row")]
    held = docs.select(
        *kept,
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(_SPAN).alias("spans"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    pieces = cut_lineage(_pieces(benchmark, window, blocks))
    for block in range(blocks):
        # The items of one block, whose size is bounded.
        rows = pieces.where(F.col("block") == block).select("item_id", "words").collect()
        held = _through(held, [(r.item_id, bytes(r.words)) for r in rows], window)
        if block < blocks - 1:
            held = cut_lineage(held)
    return held


def _span_words() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Which words of each document stand in a window of ``window`` words of a benchmark item.

    Per document: ``n_words``, ``n_hit`` (words inside any occurrence), ``n_items`` and ``item_ids``
    (items with occurring windows, sorted as strings), ``spans`` (maximal hit runs, in words from 0),
    ``longest`` (the longest of them) and ``contaminated``. An item of fewer words than a window, but
    not none, is one window. A null or empty text has no words and no hits. Rows with equal item ids
    count as one item; the windows of an item without an id count as hits but name no item. Repeated
    documents and null ids stay; other columns are not looked at; texts are taken whole. Without items
    nothing is hit.
    """
    found = _found(docs, benchmark, window, keep_columns=False)
    hit = _span_words()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        "item_ids",
        "spans",
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"] - s["first"])), F.lit(0).cast("bigint")).alias("longest"),
        (hit > 0).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, least_span: int = 0, most_cover: float = 0.5
) -> DataFrame:
    """The documents without the benchmark's passages, in their own columns.

    A hit run of ``least_span`` words or more goes from its first to its last word. A document of which
    more than ``most_cover`` of all words are hit goes as a whole. Texts without such runs stay as they
    are, null ones too.
    """
    names = docs.columns
    held = _found(docs, benchmark, window, keep_columns=True)
    held = held.where(_span_words() <= F.col("n_words") * F.lit(most_cover))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                wide = [s for s in spans if s["end"] - s["first"] >= least_span]
                if wide:
                    data = texts[row].encode()
                    places = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
                    out, at = [], 0
                    for s in wide:
                        out.append(data[at : places[s["first"]][0]])
                        at = places[s["end"] - 1][1]
                    texts[row] = b"".join([*out, data[at:]]).decode()
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    cut = held.mapInArrow(run, held.schema)
    text = F.when(~F.col("row.no_text"), F.col("text"))
    columns = [text if name == "text" else F.col(f"row.c{i}") for i, name in enumerate(names)]
    return cut.select(*columns).toDF(*names)
