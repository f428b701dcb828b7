"""Paths of the public vocabularies, character classes as their libraries have them, and memories of bounded size."""

from __future__ import annotations

from itertools import chain

import numpy as np

SPECIAL = "<|endoftext|>"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory(dict):
    """What is known of pieces; when full, it keeps what more than one batch had."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.again = most, set()

    def unknown(self, pieces: set) -> list:
        """Those of a batch's ``pieces`` to find out and put in, after room is made."""
        new = [x for x in pieces if x not in self]
        again = pieces.difference(new) if new else pieces
        if len(self) + len(new) > self.most:
            self.again |= again
            kept = {x: self[x] for x in (self.again if len(self.again) < self.most // 2 else again)}
            self.clear()
            self.update(kept)
            self.again = set()
        else:
            self.again |= again
        return new


# Letters and numbers that Unicode 16.0 added to 15.1, first and last code point of each run.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# End of fixed values.


class Classes:
    """Letters (0), numbers (1), white space (2) and others (3) of Unicode 16.0, as the tokenizers' libraries have them.

    Python's own tables may be of 15.1; what 16.0 added is stated above.
    """

    _known: "Classes | None" = None

    def __init__(self) -> None:
        import unicodedata

        self.kind = np.full(0x110000, 3, np.uint8)
        for i in chain(range(0xD800), range(0xE000, 0x110000)):
            c = chr(i)
            if (major := unicodedata.category(c)[0]) in "LN":
                self.kind[i] = major == "N"
            elif c.isspace() and not 0x1C <= i <= 0x1F:
                self.kind[i] = 2
        for k, runs in enumerate((NEW_LETTERS, NEW_NUMBERS)):
            for first, last in runs:
                self.kind[first : last + 1] = k

    @classmethod
    def get(cls) -> "Classes":
        if cls._known is None:
            cls._known = cls()
        return cls._known
