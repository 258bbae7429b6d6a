"""Substring deduplication by words, with suffix automata of reference shards.

Every distinct piece of text that may occur in two documents goes into the automaton of its shard,
owned by the smallest document that holds it. The pieces are then streamed through that automaton:
the matching statistics of a place, cut down to one window, lead to the state of that window, and the
state knows the smallest document that holds it. Shards are the buckets of ``repeats``, split along
anchors into automata of bounded size; a piece meets the one automaton that can hold its windows
instead of all of them, so nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from tideline.llm.automaton import SuffixAutomaton
from tideline.llm.repeats import Units, without_repeats

#: Words after which the next anchor starts a new automaton.
SHARD_WORDS = 20_000


def word_units(window: int = 13) -> Units:
    """Grams of 6 words for long windows: about two anchors per 9 words at 13."""
    return Units(window, max(1, min(6, (window + 1) // 2)), True)


def automaton_index(window: int):
    def index(pieces: Sequence[bytes], anchors: np.ndarray, owners: np.ndarray, windows: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(windows)])
        smallest = np.empty(starts[-1], np.int64)
        shard: list[int] = []
        held = 0
        order = np.argsort(anchors, kind="stable").tolist()

        def search() -> None:
            automaton = SuffixAutomaton()
            worded = [(k, pieces[k].split(b" ")) for k in shard]
            for k, words in worded:
                automaton.add(words, int(owners[k]))
            automaton.settle()
            link, length, first = automaton.link, automaton.length, automaton.first
            for k, words in worded:
                found = []
                for state, run in automaton.matches(words):
                    if run >= window:
                        while length[link[state]] >= window:
                            state = link[state]
                        found.append(first[state])
                smallest[starts[k] : starts[k + 1]] = found

        for place, k in enumerate(order):
            if held >= SHARD_WORDS and anchors[k] != anchors[order[place - 1]]:
                search()
                shard, held = [], 0
            shard.append(k)
            held += int(windows[k]) + window - 1
        if shard:
            search()
        return smallest

    return index


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """Every document without the words of windows that an earlier document also holds.

    ``n_units`` and ``spans`` count words; ``kept`` holds the words left, joined by one space. A null
    or empty text has no words. A document shorter than a window is left whole. See ``repeats`` for
    ids that are null or occur twice.
    """
    return without_repeats(docs, word_units(window), automaton_index(window))
