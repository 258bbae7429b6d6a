"""Documents in blocks, and sorted numbers in few bytes.

Operators that ask the whole corpus about parts of a text do so by blocks: a block holds some
megabytes of documents, chosen by the hash of their ids, and sends one message per bucket of the
answering side instead of one row per part. Blocks and messages travel as compressed bytes. Inside a
block documents stand by id and text, so their places are the same in every pass and after every
retry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Stands for a null id: larger than every other.
NO_ID = np.iinfo(np.int64).max
SCHEMA = "block int, ids binary, sizes binary, data binary, rest binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads neighbouring values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets that follow the order of evenly spread hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def squeeze(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def expand(blob: bytes, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit words as differences, byte by byte: the leading bytes are mostly zero."""
    steps = np.diff(values, prepend=np.uint64(0))
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(expand(blob).reshape(8, -1).T).reshape(-1).view(np.uint64)
    return np.cumsum(steps, dtype=np.uint64)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def block_count(docs: DataFrame) -> int:
    """So many blocks that each holds about ``BLOCK_BYTES``; found by one pass over the texts' lengths."""
    return max(1, -(-text_bytes(docs) // BLOCK_BYTES))


def in_blocks(docs: DataFrame, blocks: int, keep_rest: bool = False) -> DataFrame:
    """Rows of ``SCHEMA``: parts of blocks. With ``keep_rest`` the other columns travel along."""
    if keep_rest:
        # By place, as a name may hold anything.
        docs = docs.toDF(*[n if n in ("doc_id", "text") else f"_{i}" for i, n in enumerate(docs.columns)])
    else:
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            texts = batch.column("text").fill_null("").cast(pa.large_binary())
            block = (mixed(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for rows in np.split(order, cuts):
                own = texts.take(pa.array(rows))
                ends = np.frombuffer(own.buffers()[1], np.int64)[: len(rows) + 1]
                held = own.buffers()[2].to_pybytes() if own.buffers()[2] else b""
                rest = b""
                if keep_rest:
                    sink = pa.BufferOutputStream()
                    part = batch.take(pa.array(rows))
                    place = part.schema.get_field_index("text")
                    part = part.set_column(place, "text", pa.nulls(len(rows), part.schema.field("text").type))
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    rest = squeeze(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block[rows[0]]], pa.int32()),
                        pa.array([ids[rows].tobytes()], pa.binary()),
                        pa.array([np.diff(ends).tobytes()], pa.binary()),
                        pa.array([squeeze(held[: ends[-1]])], pa.binary()),
                        pa.array([rest], pa.binary()),
                    ],
                    ["block", "ids", "sizes", "data", "rest"],
                )

    return docs.mapInArrow(run, SCHEMA)


def documents_of(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids and texts of a block, ordered by id and text, and the order itself."""
    if not table.num_rows:
        return np.empty(0, np.int64), [], np.empty(0, np.int64)
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    texts: list[bytes] = []
    for sizes, data in zip(table.column("sizes").to_pylist(), table.column("data").to_pylist()):
        whole = expand(data).tobytes()
        ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
        texts += [whole[a:b] for a, b in zip([0, *ends], ends)]
    order = np.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), np.int64)
    return ids[order], [texts[i] for i in order], order


def rest_of(table: pa.Table, order: np.ndarray) -> pa.Table:
    """The rows that travelled along, in the order of ``documents_of``; their texts are null."""
    parts = [pa.ipc.open_stream(expand(x).tobytes()).read_all() for x in table.column("rest").to_pylist()]
    return pa.concat_tables(parts).take(pa.array(order))


def runs_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of neighbours of at most ``most`` in sum; a larger one stands alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
