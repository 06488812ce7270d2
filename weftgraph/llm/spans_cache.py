"""Cutting texts where a byte-level BPE's pre-tokeniser always cuts, so that repeated words are encoded once.

The pre-tokeniser begins a new match at every space that is followed by something other than white space. A text may
therefore be cut there, each stretch encoded by itself and the results joined. A task keeps what it encoded lately.
"""

from __future__ import annotations

import re
from collections.abc import Callable

KEPT = 400_000  # stretches of up to LONG characters in each of two generations, unless told otherwise: a worker then has 350 MB
LONG = 64  # longer ones are not kept
_CUT = re.compile(r" (?=\S)")
# white space to some engines only: texts that hold one stay whole
_WHITE_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u180e", "\u200b", "\ufeff")


class _NotAStretch(Exception):
    """What a space cut off is empty or begins with white space."""


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # letters to every engine
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII marks but the apostrophe, which may begin a match of its own kind
_PART = re.compile(f" ?[{_LETTERS}]+| ?[{_MARKS}]+|\n")
_PLAIN = re.compile(f"(?: ?[{_LETTERS}]++| ?[{_MARKS}]++|\\n(?!\\n))*+")  # possessive: no second try
_WORD = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")
ONE = re.compile(f" ?(?:[{_LETTERS}]+|[{_MARKS}]+|[0-9]+)")  # texts that are one match of the pre-tokeniser


def parts(text: str) -> list[str]:
    """The pre-tokeniser's matches, for stretches of plain letters and marks; others stay whole."""
    return _PART.findall(text) if _PLAIN.fullmatch(text) and text[-1:] != "\n" and " " not in text[1:] else [text]


class _Kept(dict):
    """The latest generation of what was encoded; the one before it is older. What is missing is made when it is looked
    up; long keys last until the next turn."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        self.most, self.make, self.older, self.long = most, make, {}, {}

    def turn(self) -> None:
        self.long.clear()
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def __missing__(self, s: str) -> bytes:
        if len(s) > LONG:
            made = self.long.get(s)
            if made is None:
                made = self.long[s] = self.make(s)
            return made
        made = self.older.get(s)
        if made is None:
            made = self.make(s)
        self[s] = made
        return made


class Encoded:
    """Bytes for each text by way of its stretches.

    ``after`` gets lists of words of letters and gives their bytes when a space stands before them; ``alone`` gets
    lists of other texts and gives the bytes of each by itself. A generation has ``kept`` stretches, about.
    """

    def __init__(self, after: Callable[[list[str]], list[bytes]], alone: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self.after, self.alone, self.kept = after, alone, kept
        self.clear()

    def clear(self) -> None:
        """Forget all: at the end of a task, so that a worker's memory is free for whatever comes next."""
        self.known, self.bare = _Kept(self.kept, self._stretch), _Kept(self.kept, self._bare)  # keys of known have a space before them

    def _bare(self, s: str) -> bytes:
        return self.alone([s])[0]

    def _stretch(self, s: str) -> bytes:
        if s.isascii() and s.isalpha():
            return self.after([s])[0]
        if not s or s[0].isspace():
            raise _NotAStretch
        m = _WORD.fullmatch(s)
        if m is None:
            pieces = parts(" " + s)
            return b"".join([self.known[p[1:]] if p[0] == " " and p[1:].isalpha() and len(pieces) > 1 else self.bare[p] for p in pieces])
        word, marks = m.groups()
        return self.known[word] + self.bare[marks] if marks else self.after([s])[0]

    def _joined(self, head: str, tails: list[str]) -> bytes:
        return b"".join([*map(self.bare.__getitem__, parts(head)), *map(self.known.__getitem__, tails)])

    def _text(self, text: str) -> bytes:
        for c in _WHITE_ODD:
            if c in text:
                return self._joined(text, [])
        head, *tails = text.split(" ")
        try:
            # a cut that the pre-tokeniser doesn't make leaves something that is never kept, so it comes to _stretch
            return self._joined(head, tails)
        except _NotAStretch:
            head, *tails = _CUT.split(text)
            return self._joined(head, tails)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i, text in enumerate(texts):
            if i % 128 == 0:
                self.known.turn(), self.bare.turn()
            out.append(self._text(text))
        return out
