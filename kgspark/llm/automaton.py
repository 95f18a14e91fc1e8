"""A generalised suffix automaton over word sequences, with the least document of every substring."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class SuffixAutomaton:
    """Sequences are added one by one; ``seal`` then makes ``least`` hold, for each state, the least owner of any occurrence."""

    __slots__ = ("least", "length", "link", "step")

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.step) - 1

    def _split(self, parent: int, child: int, word: Hashable) -> int:
        """The state of parent's strings plus ``word``, taken out of ``child`` if that holds longer ones too."""
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._state(self.length[parent] + 1, dict(self.step[child]), self.link[child])
        self.link[child] = copy
        while parent >= 0 and self.step[parent].get(word) == child:
            self.step[parent][word] = copy
            parent = self.link[parent]
        return copy

    def add(self, words: Iterable[Hashable], owner: int) -> None:
        last = 0
        for word in words:
            known = self.step[last].get(word)
            if known is not None:
                last = self._split(last, known, word)
            else:
                new, at = self._state(self.length[last] + 1, {}, 0), last
                while at >= 0 and word not in self.step[at]:
                    self.step[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._split(at, self.step[at][word], word)
                last = new
            if self.least[last] is None or owner < self.least[last]:
                self.least[last] = owner

    def seal(self) -> None:
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0 and self.least[s] is not None and (self.least[up] is None or self.least[s] < self.least[up]):
                self.least[up] = self.least[s]

    def statistics(self, words: Iterable[Hashable]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word, the longest suffix read so far that occurs (its length), and its state."""
        at, n = 0, 0
        for word in words:
            while at and word not in self.step[at]:
                at = self.link[at]
                n = self.length[at]
            if word in self.step[at]:
                at, n = self.step[at][word], n + 1
            yield n, at

    def owners(self, words: list, size: int) -> list:
        """For each window of ``size`` words, the least owner of any occurrence (None where it doesn't occur)."""
        out: list = []
        for k, (n, at) in enumerate(self.statistics(words)):
            if k + 1 < size:
                continue
            if n < size:
                out.append(None)
                continue
            while self.length[self.link[at]] >= size:
                at = self.link[at]
            out.append(self.least[at])
        return out
