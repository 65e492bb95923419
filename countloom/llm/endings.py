"""Which vocabulary entries can end at a node of a trie, passed down from its parent."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any


#: Moves remembered by all states together; beyond it they are found anew (a matter of speed only).
MOST_MOVES = 1_000_000


class State:
    """The longest end of a prefix that begins an entry; `ends`: what is to know of the entries that end there."""

    __slots__ = ("text", "ends", "moves")

    def __init__(self, text: str, ends: Any):
        self.text, self.ends = text, ends
        #: The states after one more letter, as far as they were asked for.
        self.moves: dict[str, State] = {}


class Endings:
    """States over a vocabulary's spellings, made when first met: there are as many at most as prefixes of spellings."""

    def __init__(self, spellings: Iterable[str], describe: Callable[[list[str]], Any]):
        """`describe` makes a state's `ends` from all ends of its text, longest first."""
        self.starts = {""}
        for s in spellings:
            self.starts.update(s[:k] for k in range(1, len(s) + 1))
        self.describe = describe
        self.states: dict[str, State] = {}
        self.moves = 0
        self.root = self.state("")

    def state(self, text: str) -> State:
        """The state after `text`."""
        while text not in self.starts:
            text = text[1:]
        found = self.states.get(text)
        if found is None:
            found = self.states[text] = State(text, self.describe([text[k:] for k in range(len(text))]))
        return found

    def after(self, state: State, letter: str) -> State:
        found = self.state(state.text + letter)
        if found is not self.root:  # letters that begin no entry are as many as the corpus has
            if self.moves >= MOST_MOVES:
                for other in self.states.values():
                    other.moves.clear()
                self.moves = 0
            state.moves[letter] = found
            self.moves += 1
        return found


def depth_first(words: Iterable[str]) -> Iterator[tuple[str, int]]:
    """(word, letters shared with the word before) in sorted order.

    Sorted words are their trie in depth-first order: what a word shares with the one before are the nodes
    that both lie below, so what was computed for these is still at hand.
    """
    before = ""
    for word in sorted(words):
        shared = 0
        for x, y in zip(before, word, strict=False):
            if x != y:
                break
            shared += 1
        yield word, shared
        before = word
