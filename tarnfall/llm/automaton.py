"""Generalised suffix automata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Automaton:
    """The suffix automaton of some sequences: every state is a set of their pieces that end
    at the same places. ``step``: transitions; ``link``: the state of the longest suffix that
    ends at more places; ``length``: of a state's longest piece; ``ends``: of states with pieces
    of ``least`` or more, all (sequence, place) where they end."""

    def __init__(self, sequences: Iterable[Iterable[int]], least: int | None = None):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last_of: list[tuple[int, int, int]] = []
        for which, sequence in enumerate(sequences):
            last = 0
            for end, c in enumerate(sequence, 1):
                last = self._extend(last, c)
                last_of.append((last, which, end))
        self.ends: list[list[tuple[int, int]]] = []
        if least is not None:
            self.ends = [[] for _ in self.step]
            for state, which, end in last_of:
                self.ends[state].append((which, end))
            for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
                if self.length[self.link[state]] >= least:
                    self.ends[self.link[state]] += self.ends[state]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        if (q := self.step[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def statistics(self, sequence: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest match that ends at each position."""
        state, n = 0, 0
        for c in sequence:
            while state and c not in self.step[state]:
                state = self.link[state]
                n = self.length[state]
            if (to := self.step[state].get(c)) is not None:
                state, n = to, n + 1
            yield n, state
