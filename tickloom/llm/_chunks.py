"""Tokenising long texts through a memo of the runs between single spaces.

With the pattern that byte-level vocabularies split texts by, a single space between two other characters
always begins a piece. So a text without other spacing at those places is the sequence of its space-led runs,
each of which always gives the same ids; common runs are looked up. Any other text is split by the pattern
as a whole.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

#: Runs a worker remembers, about 250 MB; the frequent ones come early, so a full memo is left as it is.
MEMO_RUNS = 1_200_000


class _Irregular(Exception):
    pass


class _Memo(dict):
    def __init__(self, encode: Callable[[str], bytes], lead: str, most: int):
        super().__init__()
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, run: str) -> bytes:
        if not run or run[0].isspace() or run[-1].isspace():
            raise _Irregular
        ids = self.encode(self.lead + run)
        if len(self) < self.most and len(run) <= 64:
            self[run] = ids
        return ids


class RunEncoder:
    """Encode texts as little-endian 32-bit ids, given the ids of one piece of the pattern."""

    def __init__(self, pattern: str, encode_piece: Callable[[str], list[int]], most: int = MEMO_RUNS):
        import regex

        self.find = regex.compile(pattern).findall
        self.encode_piece = encode_piece
        self.pieces: dict[str, bytes] = {}
        self.most = most // 4
        self.first = _Memo(self._slow, "", most // 20)
        self.later = _Memo(self._slow, " ", most)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            made = self.encode_piece(piece)
            ids = struct.pack(f"<{len(made)}I", *made)
            if len(self.pieces) < self.most and len(piece) <= 64:
                self.pieces[piece] = ids
        return ids

    def _slow(self, text: str) -> bytes:
        if text.isascii() and text[text[0] == " " :].isalpha():  # one piece of the pattern
            return self._piece(text)
        return b"".join(map(self._piece, self.find(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *later = text.split(" ")
        try:
            return b"".join((self.first[first], *map(self.later.__getitem__, later)))
        except _Irregular:
            return self._slow(text)
