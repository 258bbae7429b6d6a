"""Licence scans with a generalised suffix automaton of licence templates.

The automaton holds every run of words of every template. Streaming a text through it gives, at each
word, the longest run ending there that some template holds (its matching statistics), and along its
links the longest that each template holds. Long runs are chained along a template into covered spans:
a run counts at every place of the template that holds it, and of all chains those that cover most are
taken. A template that is covered well enough gives its label.
Short phrases that count at every place are templates of the same automaton. Its size is bounded by
the templates, which travel with the task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.automaton import SuffixAutomaton
from tideline.llm.batches import per_chunk
from tideline.llm.license_templates import BASE_PHRASES, TEMPLATES

_TABLE = bytes(
    b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def license_words(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return text.encode().translate(_TABLE).split()


class LicenseScanner:
    """Matching statistics of templates, chained into spans.

    ``least_run`` words make a run worth chaining, or all words of a shorter template. Runs of one
    template chain when both places move forward and at most ``most_gap`` words of the text lie
    between them. A template is found when a chain covers ``least_cover`` of its words; chains of one
    template share no words of the text, and those that cover most come first.
    """

    def __init__(
        self,
        phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
        templates: Sequence[tuple[str, str]] = TEMPLATES,
        least_run: int = 4,
        most_gap: int = 8,
        least_cover: float = 0.7,
    ):
        self.least_run, self.most_gap, self.least_cover = least_run, most_gap, least_cover
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        self.n_phrases = len(phrases)
        worded = [license_words(t) for t, _ in phrases] + [license_words(t) for _, t in templates]
        self.sizes = [len(w) for w in worded]
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        for template, words in enumerate(worded):
            self.automaton.add([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], template)
        a = self.automaton
        # Where each template holds a state's runs, and which phrases end a state's runs.
        held: list[dict[int, set[int]]] = [{} for _ in a.length]
        for template, words in enumerate(worded[self.n_phrases :], self.n_phrases):
            state = 0
            for end, w in enumerate(words):
                state = a.next[state][self.vocabulary[w]]
                held[state].setdefault(template, set()).add(end)
        by_length = sorted(range(len(a.length)), key=lambda v: -a.length[v])
        for v in by_length:
            if a.link[v] > 0:
                for template, places in held[v].items():
                    held[a.link[v]].setdefault(template, set()).update(places)
        self.places = [{t: sorted(places) for t, places in of.items()} for of in held]
        least = [min(least_run, n) if t >= self.n_phrases else n for t, n in enumerate(self.sizes)]
        self.least = dict(enumerate(least))
        self.shortest = min(least, default=1)
        self.shortest_run = min(least[self.n_phrases :], default=1)
        ends: list[list[tuple[int, int]]] = [[] for _ in a.length]
        for p in range(self.n_phrases):
            state = 0
            for w in worded[p]:
                state = a.next[state][self.vocabulary[w]]
            ends[state].append((p, self.sizes[p]))
        for v in reversed(by_length):
            if a.link[v] > 0:
                ends[v] = ends[v] + ends[a.link[v]]
        self.ends = ends

    def statistics(self, symbols: list[int]) -> list[tuple[int, int]]:
        """State and length of the longest known run ending at each symbol."""
        return self.automaton.matches(symbols)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Number of words, places of phrases and covered spans: start and end in words, label, cover."""
        words = license_words(text)
        n = len(words)
        symbols = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, n)
        # Runs of words that templates know; too short ones can hold nothing.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], symbols >= 0, [False]]).astype(np.int8)))
        phrases: list[tuple[int, int, str]] = []
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - start < self.shortest:
                continue
            open_runs: dict[int, tuple[int, int]] = {}
            for end, (state, length) in enumerate(self.statistics(symbols[start:stop].tolist()), start + 1):
                if length >= self.shortest:
                    for p, size in self.ends[state]:
                        if length >= size:
                            phrases.append((end - size, end, self.labels[p]))
                open_runs = self._ended(open_runs, self._longest(state, length), end - 1, anchors)
            self._ended(open_runs, {}, stop, anchors)
        return n, phrases, sorted(span for t, held in anchors.items() for span in self._spans(t, held))

    def _longest(self, state: int, length: int) -> dict[int, tuple[int, int]]:
        """For each template the longest run ending here that it holds, if long enough: length and state."""
        found: dict[int, tuple[int, int]] = {}
        link, lengths = self.automaton.link, self.automaton.length
        while state > 0 and length >= self.shortest_run:
            for template in self.places[state]:
                if length >= self.least[template]:
                    found.setdefault(template, (length, state))
            state = link[state]
            length = lengths[state]
        return found

    def _ended(
        self,
        before: dict[int, tuple[int, int]],
        now: dict[int, tuple[int, int]],
        end: int,
        anchors: dict[int, list[tuple[int, int, int]]],
    ) -> dict[int, tuple[int, int]]:
        """Runs that the next word does not prolong become anchors: end in the text, place, length."""
        for template, (length, state) in before.items():
            if now.get(template, (0, 0))[0] != length + 1:
                held = anchors.setdefault(template, [])
                held += [(end, place, length) for place in self.places[state][template]]
        return now

    def _spans(self, template: int, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """The chains of a template that cover most, none over another."""
        anchors.sort()
        best, previous = [], []
        first = 0
        for i, (end, place, length) in enumerate(anchors):
            best.append(length)
            previous.append(-1)
            # Ends grow by less than a run's length, so few earlier anchors are near enough.
            while anchors[first][0] < end - self.sizes[template] - self.most_gap:
                first += 1
            for j in range(first, i):
                other_end, other_place, _ = anchors[j]
                if other_end < end and other_place < place and end - length - other_end <= self.most_gap:
                    covered = best[j] + min(length, end - other_end, place - other_place)
                    if covered > best[i]:
                        best[i], previous[i] = covered, j
        spans: list[tuple[int, int, str, float]] = []
        for i in sorted(range(len(anchors)), key=lambda i: (-best[i], anchors[i])):
            cover = min(1.0, best[i] / self.sizes[template])
            if cover < self.least_cover:
                break
            at = i
            while previous[at] >= 0:
                at = previous[at]
            start, end = anchors[at][0] - anchors[at][2], anchors[i][0]
            if all(end <= a or b <= start for a, b, _, _ in spans):
                spans.append((start, end, self.labels[template], cover))
        return spans


def license_scan(docs: DataFrame, scanner: LicenseScanner | None = None) -> DataFrame:
    """Words, places of base phrases, labels and covered spans of every text.

    ``score`` is the best cover of a template, 1 where a base phrase stands. A null or empty text has
    no words, no labels (empty strings) and score 0. Repeated rows and null ids stay; other columns
    are not looked at; texts are scanned whole. Equal covers are all reported.
    """

    def make():
        held = scanner or LicenseScanner()

        def work(doc_ids, texts):
            columns: list[list] = [[] for _ in range(8)]
            for text in texts:
                n, phrases, spans = held.scan(text)
                base = {label for _, _, label in phrases}
                starts = [start for start, _, _ in phrases]
                row = (
                    n,
                    len(phrases),
                    min(starts, default=None),
                    max(starts, default=None),
                    ",".join(sorted(base)),
                    ",".join(sorted(base | {label for _, _, label, _ in spans})),
                    1.0 if base else max((cover for *_, cover in spans), default=0.0),
                    [{"first": a, "end": b, "label": label, "cover": cover} for a, b, label, cover in spans],
                )
                for column, value in zip(columns, row):
                    column.append(value)
            span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            return pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", *names]
            )

        return work

    return per_chunk(
        docs,
        make,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<first:bigint,end:bigint,label:string,cover:double>>",
    )
