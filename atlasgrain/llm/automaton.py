"""A suffix automaton over words: all substrings of some texts, and matching statistics of a stream."""

from __future__ import annotations


class SuffixAutomaton:
    """Accepts every run of words of ``texts``; runs do not cross from one text to the next."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)

    def _new(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.length.append(length), self.link.append(link), self.next.append(moves)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, word: bytes) -> int:
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, word: bytes) -> int:
        if (q := self.next[last].get(word)) is not None:  # a later text begins like an earlier one
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def matching(self, words: list[bytes]) -> list[int]:
        """For each place, the length of the longest run ending there that the automaton accepts."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append(n)
        return out
