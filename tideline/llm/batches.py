"""Arrow batches of documents inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tideline.llm.texts import id_and_text

#: Texts decoded at once; a longer text is decoded alone.
CHUNK_BYTES = 4 << 20


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, a few megabytes at a time."""
    ids, texts = batch.column("doc_id"), batch.column("text")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > CHUNK_BYTES:
            yield ids.slice(start, i - start).to_pylist(), texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += int(size)
    if len(sizes) > start:
        yield ids.slice(start).to_pylist(), texts.slice(start).to_pylist()


def per_chunk(
    docs: DataFrame, make: Callable[[], Callable[[list, list[str]], pa.RecordBatch | Iterable]], schema: str
) -> DataFrame:
    """``make()`` once per task, then its result on the ids and texts of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for ids, texts in chunks(batch):
                yield work(ids, texts)

    return id_and_text(docs).mapInArrow(run, schema)


class Remembered(dict):
    """Results per key, worked out on first use; beyond ``most`` keys they are not kept."""

    def __init__(self, work: Callable, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.work, self.most, self.longest = work, most, longest

    def __missing__(self, key):
        value = self.work(key)
        if len(self) < self.most and len(key) <= self.longest:
            self[key] = value
        return value
