"""A suffix automaton over word sequences that knows, for every sequence it holds, the smallest
document it occurs in."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Add texts with their documents, `finish`, then stream texts through it."""

    def __init__(self) -> None:
        self.moves: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least: list[int | None] = [None]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.link) - 1

    def _split(self, before: int, state: int, word) -> int:
        """A copy of `state` for the sequences that end in one more word than those of `before`."""
        copy = self._state(self.length[before] + 1, dict(self.moves[state]), self.link[state])
        while before >= 0 and self.moves[before].get(word) == state:
            self.moves[before][word] = copy
            before = self.link[before]
        self.link[state] = copy
        return copy

    def add(self, words: Sequence, doc: int) -> None:
        last = 0
        for word in words:
            known = self.moves[last].get(word)
            if known is not None:
                if self.length[known] != self.length[last] + 1:
                    known = self._split(last, known, word)
                last = known
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                at = last
                while at >= 0 and word not in self.moves[at]:
                    self.moves[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    state = self.moves[at][word]
                    exact = self.length[state] == self.length[at] + 1
                    self.link[new] = state if exact else self._split(at, state, word)
                last = new
            if self.least[last] is None or doc < self.least[last]:
                self.least[last] = doc

    def finish(self) -> None:
        """Hands each state's smallest document down its suffix links."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            to, doc = self.link[state], self.least[state]
            if doc is not None and (self.least[to] is None or doc < self.least[to]):
                self.least[to] = doc

    def matches(self, words: Sequence, most: int) -> list[tuple[int, int | None]]:
        """After each word: the length of the longest suffix that the automaton holds, at most
        `most`, and the smallest document that this suffix occurs in."""
        state = size = 0
        found = []
        for word in words:
            while state and word not in self.moves[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.moves[state]:
                state, size = self.moves[state][word], size + 1
            if size > most:
                size = most
            while self.link[state] >= 0 and self.length[self.link[state]] >= size > 0:
                state = self.link[state]
            found.append((size, self.least[state] if size else None))
        return found
