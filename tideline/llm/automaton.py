"""A generalised suffix automaton over hashable symbols, with the smallest owner of every run."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """All runs of the sequences added so far.

    ``first[state]`` is the smallest owner among the sequences that hold the state's runs, once
    ``settle`` has passed owners along the links. Sequences may be added in any order.
    """

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list[int] = [0]

    def _new(self, length: int, owner: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.first.append(owner)
        return len(self.length) - 1

    def _clone(self, state: int, origin: int, symbol: Hashable) -> int:
        """A copy of ``origin`` for its runs that end ``state``'s runs and ``symbol``."""
        copy = self._new(self.length[state] + 1, self.first[origin])
        self.next[copy] = self.next[origin].copy()
        self.link[copy] = self.link[origin]
        self.link[origin] = copy
        while state >= 0 and self.next[state].get(symbol) == origin:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: Iterable[Hashable], owner: int) -> None:
        following, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for symbol in sequence:
            known = following[last].get(symbol)
            if known is not None:
                # The run is held already; only its state may cover longer runs as well.
                last = known if length[known] == length[last] + 1 else self._clone(last, known, symbol)
                if owner < first[last]:
                    first[last] = owner
                continue
            state = self._new(length[last] + 1, owner)
            at = last
            while at >= 0 and symbol not in following[at]:
                following[at][symbol] = state
                at = link[at]
            if at >= 0:
                known = following[at][symbol]
                link[state] = known if length[known] == length[at] + 1 else self._clone(at, known, symbol)
            last = state

    def settle(self) -> None:
        """A run is also owned by the owners of all runs that it ends."""
        first, link = self.first, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if up > 0 and first[state] < first[up]:
                first[up] = first[state]

    def matches(self, sequence: Sequence[Hashable]) -> list[tuple[int, int]]:
        """State and length of the longest held run that ends at each symbol: the matching statistics."""
        following, link, length = self.next, self.link, self.length
        state = run = 0
        found = []
        for symbol in sequence:
            step = following[state].get(symbol)
            while step is None and state:
                state = link[state]
                run = length[state]
                step = following[state].get(symbol)
            if step is not None:
                state = step
                run += 1
            found.append((state, run))
        return found
