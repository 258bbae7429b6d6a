"""Passages that also start in an earlier document: the search that two operators share.

A window is a fixed number of units (words or bytes) of one document. The search is exact and sends
neither all windows nor all texts to one place:

1. Of every window, the gram with the smallest hash is its anchor. Equal windows have equal anchors,
   and neighbouring windows mostly share theirs, so anchors are few. Blocks send their distinct
   anchors; those that occur in two documents or more come back.
2. Windows with such an anchor are cut out as pieces, one per run of windows with the same anchor,
   and go to the bucket of the anchor. All copies of a window meet there. Of equal pieces inside a
   block only the earliest document's goes on, so a passage of a third of all documents sends one
   piece per block; the later ones are known to be repeated. Around such a passage every document's
   windows differ while their anchor is the same; windows of an anchor that very many documents hold
   are therefore pieces of their own, which go to the buckets of their own hashes.
3. A bucket finds, for every window of its distinct pieces, the smallest document that holds it,
   with an index over the pieces themselves. Spans go back to the blocks.
4. Blocks cut the spans out of their texts.

Anchors are 64-bit hashes; a collision costs a useless comparison and nothing else, as the index
compares the units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tideline.llm.blocks import (
    NO_ID,
    block_count,
    bucket_of,
    documents_of,
    expand,
    in_blocks,
    mixed,
    pack_sorted,
    rest_of,
    runs_of,
    squeeze,
    unpack_sorted,
)

#: Text looked at in one numpy step.
STEP_BYTES = 1 << 20
#: Documents beyond which an anchor's windows go to buckets of their own.
HOT_DOCUMENTS = 16_384
_BASE = 0x9E3779B97F4A7C15

#: Smallest document per window of each distinct piece, in the order of pieces and windows.
#: Called with the pieces, their anchors, their smallest documents and their numbers of windows.
Index = Callable[[Sequence[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Units:
    """What windows are made of."""

    window: int
    gram: int
    words: bool

    def split(self, text: bytes) -> Sequence:
        return text.split() if self.words else text

    def hashes(self, parts: list[Sequence]) -> np.ndarray:
        if self.words:
            found = [np.fromiter(map(xxhash.xxh3_64_intdigest, p), np.uint64, len(p)) for p in parts]
            return np.concatenate(found) if found else np.empty(0, np.uint64)
        return _BYTE_HASHES[np.frombuffer(b"".join(parts), np.uint8)]

    def join(self, part: Sequence) -> bytes:
        return b" ".join(part) if self.words else part


_BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of ``size`` neighbours, put together from lengths that are powers of two."""
    power, length, held, rest = units, 1, None, 0
    while True:
        if size & length:
            if held is None:
                held, rest = power, length
            else:
                # The longer part stands first.
                n = len(units) - (rest + length) + 1
                held = power[:n] * np.uint64(pow(_BASE, rest, 1 << 64)) + held[length : length + n]
                rest += length
        if length * 2 > size:
            return mixed(held)
        n = len(units) - 2 * length + 1
        power = power[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + power[length : length + n]
        length *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = np.minimum(values[: len(values) - (width - size)], values[width - size :])
    return values


def anchor_runs(hashes: np.ndarray, sizes: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first unit, number of windows, anchor, document."""
    window, none = units.window, np.empty(0, np.int64)
    if len(hashes) < window:
        return none, none, none.astype(np.uint64), none
    least = sliding_least(gram_hashes(hashes, units.gram), window - units.gram + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    valid = doc[: len(least)] == doc[window - 1 :]
    new = np.empty(len(least), bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= doc[1 : len(least)] != doc[: len(least) - 1]
    first = np.flatnonzero(new & valid)
    # A run ends where the next one starts or where windows stop being valid.
    stop = np.flatnonzero(np.append(new[1:], True) & valid | valid & ~np.append(valid[1:], False)) + 1
    return first, stop - first, mixed(least[first]), doc[first]


def _steps(texts: list[bytes], units: Units) -> Iterator[tuple[int, list[Sequence], np.ndarray]]:
    for a, b in runs_of([len(t) for t in texts], STEP_BYTES):
        parts = [units.split(t) for t in texts[a:b]]
        yield a, parts, np.array([len(p) for p in parts], np.int64)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("holders", pa.binary())])
_REPLIES = pa.schema([("block", pa.int32()), ("hashes", pa.binary()), ("hot", pa.binary())])
_PIECES = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int32()), ("spans", pa.binary())]
    + [(n, pa.binary()) for n in ("anchors", "docs", "places", "sizes", "contents")]
)
_SPANS = pa.schema([("block", pa.int32()), ("spans", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if pa.types.is_int32(f.type) else 'binary'}" for f in schema)


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of ascending hashes per bucket."""
    held = bucket_of(hashes, buckets)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(held)) + 1, [len(held)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(held[a]), slice(int(a), int(b))


def shared_anchors(blocks: DataFrame, units: Units, buckets: int) -> DataFrame:
    """Per block, those of its anchors that two documents or more hold, and whether very many do."""

    def ask(table: pa.Table) -> pa.Table:
        ids, texts, _ = documents_of(table)
        anchors, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for at, parts, sizes in _steps(texts, units):
            _, _, anchor, doc = anchor_runs(units.hashes(parts), sizes, units)
            anchors.append(anchor)
            docs.append(ids[at + doc])
        anchor, doc = np.concatenate(anchors), np.concatenate(docs)
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.empty(0, np.int64)
        distinct, holders = anchor[first], np.empty(0, np.uint32)
        if len(first):
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
            holders = np.add.reduceat(new.astype(np.uint32), first).astype(np.uint32)
        block = table.column("block")[0].as_py()
        return _batch(
            _ANCHORS,
            [
                (bucket, block, pack_sorted(distinct[s]), squeeze(holders[s]))
                for bucket, s in _by_bucket(distinct, buckets)
            ],
        )

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
        given = [expand(x, np.uint32) for x in table.column("holders").to_pylist()]
        distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
        holders = np.bincount(place, np.concatenate(given), len(distinct))
        ends = np.cumsum([len(a) for a in asked])
        rows = []
        for block, own, p in zip(table.column("block").to_pylist(), asked, np.split(place, ends[:-1])):
            shared = holders[p] > 1
            if shared.any():
                rows.append((block, pack_sorted(own[shared]), squeeze(np.packbits(holders[p][shared] > HOT_DOCUMENTS))))
        return _batch(_REPLIES, rows)

    asked = blocks.groupBy("block").applyInArrow(ask, _ddl(_ANCHORS))
    return asked.groupBy("bucket").applyInArrow(answer, _ddl(_REPLIES))


def _members(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[place] == wanted


def _single_windows(
    hashes: np.ndarray, window: int, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, doc: np.ndarray, single: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Runs of windows, of which the ``single`` ones become runs of one window, with its own hash as anchor."""
    n = count[single]
    starts = np.repeat(first[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    whole = mixed(gram_hashes(hashes, window)[starts])
    parts = ((first, starts), (count, np.ones(len(starts), count.dtype)), (anchor, whole), (doc, np.repeat(doc[single], n)))
    return tuple(np.concatenate([kept[~single], new]) for kept, new in parts)


def pieces_of(blocks: DataFrame, units: Units, buckets: int) -> DataFrame:
    """Runs of windows that may occur in another document, by the bucket in which all copies meet."""
    window = units.window

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not replies.num_rows or not table.num_rows:
            return _batch(_PIECES, [])
        replied = [unpack_sorted(x) for x in replies.column("hashes").to_pylist()]
        flags = [np.unpackbits(expand(x), count=len(a)) for a, x in zip(replied, replies.column("hot").to_pylist())]
        shared, hot = np.concatenate(replied), np.concatenate(flags).astype(bool)
        hot = np.sort(shared[hot])
        shared = np.sort(shared)
        ids, texts, _ = documents_of(table)
        block = table.column("block")[0].as_py()
        earliest: dict[bytes, int] = {}
        known, sent, contents = [], [], []
        for at, parts, sizes in _steps(texts, units):
            hashes = units.hashes(parts)
            first, count, anchor, doc = anchor_runs(hashes, sizes, units)
            held = _members(shared, anchor)
            first, count, anchor, doc = first[held], count[held], anchor[held], doc[held]
            single = _members(hot, anchor)
            if single.any():
                first, count, anchor, doc = _single_windows(hashes, window, first, count, anchor, doc, single)
            offset = np.concatenate([[0], np.cumsum(sizes)])[doc]
            for a, d, start, n in zip(anchor.tolist(), doc.tolist(), (first - offset).tolist(), count.tolist()):
                piece = units.join(parts[d][start : start + n + window - 1])
                owner = int(ids[at + d])
                if earliest.setdefault(piece, owner) < owner:
                    known.append((at + d, start, start + n + window - 1))
                else:
                    sent.append((a, owner, at + d, start, n))
                    contents.append(piece)
        rows = []
        if known:
            rows.append((block % buckets, block, squeeze(np.array(known, np.int32)), *[None] * 5))
        if sent:
            anchors = np.array([x[0] for x in sent], np.uint64)
            order = np.argsort(anchors, kind="stable")
            anchors = anchors[order]
            numbers = np.array([x[1:] for x in sent], np.int64)[order]
            for bucket, s in _by_bucket(anchors, buckets):
                own = [contents[i] for i in order[s]]
                rows.append(
                    (
                        bucket,
                        block,
                        None,
                        pack_sorted(anchors[s]),
                        squeeze(numbers[s, 0]),
                        squeeze(numbers[s, 1:].astype(np.int32)),
                        squeeze(np.array([len(x) for x in own], np.int32)),
                        squeeze(b"".join(own)),
                    )
                )
        return _batch(_PIECES, rows)

    replies = shared_anchors(blocks, units, buckets)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(cut, _ddl(_PIECES))


def repeated_spans(blocks: DataFrame, units: Units, index: Index, buckets: int) -> DataFrame:
    """Per block, spans of units that an earlier document holds: document's place, start, end."""
    window = units.window

    def settle(table: pa.Table) -> pa.Table:
        rows = [(r["block"], r["spans"]) for r in table.select(["block", "spans"]).to_pylist() if r["spans"] is not None]
        number: dict[bytes, int] = {}
        least, anchors, windows = [], [], []
        seen: dict[int, list[np.ndarray]] = {}
        for r in table.to_pylist():
            if r["spans"] is not None:
                continue
            owners, places = expand(r["docs"], np.int64), expand(r["places"], np.int32).reshape(-1, 3)
            whole = expand(r["contents"]).tobytes()
            ends = np.cumsum(expand(r["sizes"], np.int32), dtype=np.int64).tolist()
            which = np.empty(len(owners), np.int64)
            for i, (a, b, anchor, owner, n) in enumerate(
                zip([0, *ends], ends, unpack_sorted(r["anchors"]).tolist(), owners.tolist(), places[:, 2].tolist())
            ):
                k = number.setdefault(whole[a:b], len(number))
                if k == len(least):
                    least.append(owner)
                    anchors.append(anchor)
                    windows.append(n)
                elif owner < least[k]:
                    least[k] = owner
                which[i] = k
            seen.setdefault(r["block"], []).append(np.column_stack([which, owners, places.astype(np.int64)]))
        if number:
            windows = np.array(windows, np.int64)
            smallest = index(list(number), np.array(anchors, np.uint64), np.array(least, np.int64), windows)
            starts = np.concatenate([[0], np.cumsum(windows)[:-1]])
            low, high = np.minimum.reduceat(smallest, starts), np.maximum.reduceat(smallest, starts)
            for block, parts in seen.items():
                own = np.concatenate(parts)
                k, owner = own[:, 0], own[:, 1]
                whole = high[k] < owner
                spans = [np.column_stack([own[whole, 2], own[whole, 3], own[whole, 3] + own[whole, 4] + window - 1])]
                for k, owner, place, start, n in own[~whole & (low[k] < owner)].tolist():
                    hit = smallest[starts[k] : starts[k] + n] < owner
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    a, b = edges[::2] + start, edges[1::2] + start + window - 1
                    spans.append(np.column_stack([np.full(len(a), place), a, b]))
                found = np.concatenate(spans)
                if len(found):
                    rows.append((block, squeeze(found.astype(np.int32))))
        return _batch(_SPANS, rows)

    return pieces_of(blocks, units, buckets).groupBy("bucket").applyInArrow(settle, _ddl(_SPANS))


def united(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching (start, end) rows of one document as maximal ones."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.column_stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]])


def without_repeats(
    docs: DataFrame, units: Units, index: Index, buckets: int | None = None, replace_text: bool = False
) -> DataFrame:
    """Every document with its repeated units cut out.

    Columns: ``doc_id``, ``n_units``, ``n_removed``, ``spans`` (start and end in units, maximal),
    ``kept`` (what is left, as bytes). With ``replace_text`` instead the columns of ``docs``, with
    the text less the characters that lie wholly inside spans (words are joined by one space where
    something was cut).

    Null texts are empty; null ids count as larger than all others, and two of them as equal, so
    neither is cut for the other. Rows with the same id never cut each other. Extra columns are
    ignored, or kept as they are with ``replace_text``, whatever their names.
    """
    count = block_count(docs)
    blocks = in_blocks(docs, count, replace_text)
    # Pieces are a part of the text, anchors fewer still; one bucket answers about one block.
    spans = repeated_spans(blocks, units, index, buckets or count)
    if replace_text:
        from pyspark.sql.pandas.types import to_arrow_schema

        kept_schema, kept_ddl = to_arrow_schema(docs.schema), docs.schema
    else:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kept_schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_units", pa.int64()),
                ("n_removed", pa.int64()),
                ("spans", pa.list_(span)),
                ("kept", pa.binary()),
            ]
        )
        kept_ddl = "doc_id bigint, n_units bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"

    def cut_out(table: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts, order = documents_of(table)
        parts = [expand(x, np.int32).reshape(-1, 3) for x in found.column("spans").to_pylist()]
        spans = np.concatenate(parts) if parts else np.empty((0, 3), np.int32)
        spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
        bounds = np.searchsorted(spans[:, 0], np.arange(len(ids) + 1))
        sizes, removed, places, kept = [], [], [], []
        for i, text in enumerate(texts):
            own = spans[bounds[i] : bounds[i + 1], 1:]
            split = units.split(text)
            cut = united(own).tolist() if len(own) else []
            sizes.append(len(split))
            removed.append(sum(b - a for a, b in cut))
            places.append([{"start": a, "end": b} for a, b in cut])
            if replace_text and not cut:
                kept.append(text)
                continue
            if replace_text and not units.words:
                cut = [_whole_characters(text, a, b) for a, b in cut]
            left, at = [], 0
            for a, b in [*cut, (len(split), len(split))]:
                left.append(split[at:a])
                at = max(at, b)
            kept.append(b" ".join(w for x in left for w in x) if units.words else b"".join(left))
        if replace_text:
            rest = rest_of(table, order)
            columns = [
                pa.array([k.decode() for k in kept], f.type) if f.name == "text" else rest.column(i).cast(f.type)
                for i, f in enumerate(kept_schema)
            ]
            return pa.Table.from_arrays(columns, schema=kept_schema)
        names = [None if i == NO_ID else int(i) for i in ids]
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip((names, sizes, removed, places, kept), kept_schema)], schema=kept_schema
        )

    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut_out, kept_ddl)


def _whole_characters(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a span of bytes that holds whole characters."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end
