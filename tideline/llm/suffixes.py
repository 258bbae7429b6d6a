"""Suffix-array deduplication by bytes, with a logarithmic family of indexes.

New batches of text get a suffix array: their suffixes, up to the window's length, in order. The
array is merge-scanned against the levels of the family for suffixes that agree over a whole window,
and becomes a level itself; two levels of about the same size merge into the next one, so a suffix
is moved a logarithmic number of times. Each bucket of ``repeats`` keeps one such family and takes
its distinct pieces in the order of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from tideline.llm.repeats import Units, without_repeats

#: Suffixes in a new batch.
BATCH = 1 << 15


class IndexFamily:
    """Levels of sorted distinct windows with the smallest document of each, the largest level first."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys with their smallest documents, and the place of every key among them."""
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        return ordered[new], np.minimum.reduceat(docs[order], np.flatnonzero(new)), place

    def add(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The smallest document so far, the batch included, that holds each window of the batch."""
        own, least, place = self._distinct(keys, docs)
        found = least.copy()
        for level, owners in self.levels:
            at = np.minimum(np.searchsorted(level, own), len(level) - 1)
            hit = level[at] == own
            found[hit] = np.minimum(found[hit], owners[at[hit]])
        self.levels.append((own, least))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (b, b_docs), (a, a_docs) = self.levels.pop(), self.levels.pop()
            merged, owners, _ = self._distinct(np.concatenate([a, b]), np.concatenate([a_docs, b_docs]))
            self.levels.append((merged, owners))
        return found[place]


def family_index(window: int):
    def index(pieces: Sequence[bytes], anchors: np.ndarray, owners: np.ndarray, windows: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(windows)])
        smallest = np.empty(starts[-1], np.int64)
        family = IndexFamily()
        order = np.argsort(owners, kind="stable")
        # Batches of whole pieces.
        ends = np.cumsum(windows[order])
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(BATCH, ends[-1], BATCH)) + 1, len(order)))
        for batch in np.split(order, cuts[:-1]):
            text = np.frombuffer(b"".join([pieces[k] for k in batch]), np.uint8)
            n = windows[batch]
            # Within the batch's text, piece by piece, the starts of its windows.
            shift = np.repeat(np.concatenate([[0], np.cumsum(n + window - 1)[:-1]]) - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            at = np.arange(n.sum()) + shift
            keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, window)[at])
            found = family.add(keys.view(f"S{window}").ravel(), np.repeat(owners[batch], n))
            target = np.arange(n.sum()) + np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            smallest[target] = found
        return smallest

    return index


def byte_units(window: int = 50) -> Units:
    """Grams of 24 bytes for long windows: about two anchors per 28 bytes at 50."""
    return Units(window, max(1, min(24, window // 2)), False)


def suffix_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Every document without the bytes of windows that an earlier document also holds.

    ``n_units`` and ``spans`` count bytes of UTF-8; ``kept`` holds the bytes left, which may cut a
    character. A null or empty text has no bytes. See ``repeats`` for ids that are null or occur twice.
    """
    return without_repeats(docs, byte_units(window), family_index(window))


def cut_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """The rows of ``docs`` with repeated bytes cut from their texts; characters are cut whole."""
    return without_repeats(docs, byte_units(window), family_index(window), replace_text=True)
