"""A vocabulary as an implicit trie over its sorted words, and edit automata that walk it.

A node is a range of the sorted list with a common prefix; a step narrows the range by bisection. The
memory is that of the words, whatever the depth.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable

END = "\U0010ffff"
#: Nodes whose children are held.
HELD = 100_000


class Trie:
    """Sorted words with a weight each."""

    def __init__(self, words: Iterable[tuple[str, int]]):
        pairs = sorted(words)
        self.words = [w for w, _ in pairs]
        self.weight = [n for _, n in pairs]
        self.letters = sorted({ch for w in self.words for ch in w})
        self._children: dict[str, list[tuple[str, tuple[int, int, str]]]] = {}

    def root(self) -> tuple[int, int, str]:
        return 0, len(self.words), ""

    def step(self, node: tuple[int, int, str], ch: str) -> tuple[int, int, str] | None:
        """The child along ``ch``, or None."""
        lo, hi, prefix = node
        prefix += ch
        a = bisect_left(self.words, prefix, lo, hi)
        if a == hi or not self.words[a].startswith(prefix):
            return None
        return a, bisect_left(self.words, prefix + END, a, hi), prefix

    def walk(self, node: tuple[int, int, str], text: str) -> tuple[int, int, str] | None:
        """The node below along all of ``text``, or None."""
        lo, hi, prefix = node
        prefix += text
        a = bisect_left(self.words, prefix, lo, hi)
        if a == hi or not self.words[a].startswith(prefix):
            return None
        return a, bisect_left(self.words, prefix + END, a, hi), prefix

    def word_at(self, node: tuple[int, int, str]) -> int:
        """Index of the word that ends at the node, or -1."""
        lo, hi, prefix = node
        return lo if lo < hi and self.words[lo] == prefix else -1

    def children(self, node: tuple[int, int, str]) -> list[tuple[str, tuple[int, int, str]]]:
        """All children, by bisection from one to the next; kept for the nodes walked most often, those near the root."""
        lo, hi, prefix = node
        out = self._children.get(prefix)
        if out is None:
            out, at, depth = [], lo, len(prefix)
            if at < hi and len(self.words[at]) == depth:
                at += 1
            while at < hi:
                ch = self.words[at][depth]
                child = self.walk((at, hi, ""), prefix + ch)
                out.append((ch, child))
                at = child[1]
            if len(self._children) > HELD:
                self._children.clear()
            self._children[prefix] = out
        return out


#: Transitions of an edit automaton at one position: (characters of the token used, text walked in the trie or None for any one letter, cost).
Edits = Callable[[str, int], Iterable[tuple[int, str | None, int]]]


def weighted(trie: Trie, token: str, edits: Edits, bound: int, least: int = 1) -> dict[int, int]:
    """Intersect the trie with a weighted edit automaton of ``token``: index of each word within ``bound`` -> least cost.

    States are (position, node), explored with their least cost, so every word that any sequence of edits within the
    bound reaches is found. ``least`` is the cost of the cheapest edit that is not free: where it no longer fits, and a letter that
    matches is the only free transition, what is left of the token is looked up as a whole. Automata with other free
    transitions give ``least`` 0.
    """
    best: dict[tuple[int, str], int] = {}
    out: dict[int, int] = {}
    words = trie.words
    stack = [(0, trie.root(), 0)]
    while stack:
        i, node, cost = stack.pop()
        lo, hi, prefix = node
        if least and cost + least > bound:
            word = prefix + token[i:]
            at = bisect_left(words, word, lo, hi)
            if at < hi and words[at] == word and out.get(at, bound + 1) > cost:
                out[at] = cost
            continue
        state = (i, prefix)
        if best.get(state, bound + 1) <= cost:
            continue
        best[state] = cost
        if i == len(token):
            at = trie.word_at(node)
            if at >= 0:
                out[at] = min(cost, out.get(at, bound))
        for used, text, extra in edits(token, i):
            now = cost + extra
            if now > bound:
                continue
            if text is None:
                stack.extend((i + used, child, now) for _, child in trie.children(node))
            else:
                child = trie.walk(node, text) if text else node
                if child is not None:
                    stack.append((i + used, child, now))
    return out


def levenshtein_edits(cost: int = 1) -> Edits:
    """The plain automaton: a match is free; a substitution, an insertion and a deletion have one cost each."""

    def edits(token: str, i: int):
        if i < len(token):
            yield 1, token[i], 0
            yield 1, None, cost
            yield 1, "", cost
        yield 0, None, cost

    return edits
