"""Words of whole texts as 64-bit hashes, found in Arrow buffers with numpy."""

import numpy as np

from panelfold.llm.textscan import _power_tables, mix

BLANK, BREAK = 0x20, 0x0A
_Q = np.uint64(0xD6E8FEB86659FD93)


def byte_table(blanks: bytes, breaks: bytes = b"") -> bytes:
    """Translation that folds A-Z and turns ``blanks`` into BLANK and ``breaks`` into BREAK."""
    table = bytearray(range(256))
    table[65:91] = bytes(range(97, 123))
    for b in blanks:
        table[b] = BLANK
    for b in breaks:
        table[b] = BREAK
    return bytes(table)


class Words:
    """All words of a list of texts in order.

    ``hash`` identifies a word, ``row`` is its text, ``joins`` says that the next word is
    of the same text with no break between; ``start`` and ``end`` are bytes of ``data``,
    the folded texts one after the other.
    """

    def __init__(self, texts: list[bytes], table: bytes):
        self.data = (b"\n".join(t.translate(table) for t in texts) + b"\n") if texts else b""
        data = np.frombuffer(self.data, np.uint8)
        inside = (data != BLANK) & (data != BREAK)
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.start, self.end = edge[::2], edge[1::2]
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * power[:len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start]
                        + (self.end - self.start).astype(np.uint64))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.row = np.searchsorted(ends, self.start, "right")
        breaks = np.cumsum(data == BREAK)
        at = breaks[self.start] if len(self.start) else self.start
        self.joins = np.r_[at[1:] == at[:-1], np.zeros(min(1, len(at)), bool)]

    def text(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last``, one blank between."""
        return b" ".join(self.data[self.start[first]:self.end[last]].split())


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order."""
    count = max(0, len(hashes) - width + 1)
    total = np.full(count, np.uint64(width))
    for k in range(width):
        total = (total + hashes[k:k + count]) * _Q
        total ^= total >> np.uint64(29)
    return mix(total)
