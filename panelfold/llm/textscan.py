"""Words and shingles of whole texts, taken from Arrow buffers with numpy.

A batch is cut into pieces of bounded bytes, so memory follows the piece (or
one text, where that is longer), never the batch or the partition.
"""

import numpy as np
import pyarrow as pa

PIECE_BYTES, TABLE_STEP = 1 << 20, 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(batches, column="text", limit=PIECE_BYTES):
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        sizes = batch.column(place).cast(pa.large_binary())
        lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[
            sizes.offset:sizes.offset + len(sizes) + 1]) if len(sizes) else np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
    batch = sizes = None
    pa.default_memory_pool().release_unused()  # the worker lives on beside the tasks of later stages


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(max(count, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < count:
        step = min(done, count - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_CACHE: dict = {}


def _power_tables(count: int):
    """Powers of the base and of its inverse; the longest pair asked for is kept."""
    if len(_CACHE.get("p", ())) < count:
        size = -(-count // TABLE_STEP) * TABLE_STEP
        tables = _powers(_P, size), _powers(_P_INVERSE, size)
        if size > 8 * PIECE_BYTES:
            return tables
        _CACHE["p"], _CACHE["q"] = tables
    return _CACHE["p"], _CACHE["q"]


def _folding() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for c in range(128):
        if chr(c).isalnum():
            table[c] = ord(chr(c).lower())
    table[128:] = np.arange(128, 256)
    return table


_FOLD = _folding()


def _fold(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    # Capitals of the Latin-1 supplement are C3 80 to C3 9E, without C3 97.
    second = (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    second[1:] &= data[:-1] == 0xC3
    second[:1] = False
    out[second] += 0x20
    return out


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Shingles:
    """Hashes of the word shingles of a list of texts, and where each one lies.

    ``hash``, ``row``, ``start`` and ``end`` (bytes in the joined folded texts)
    hold one entry per shingle. A text of fewer than ``width`` words has its whole
    word sequence as one shingle; a text without words has none.
    """

    def __init__(self, texts: list[bytes], width: int = 5):
        joined = b" ".join(texts) + b" "
        data = _fold(np.frombuffer(joined, np.uint8))
        # Words of one text never run into the next: a blank stands between.
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        inside = data != 0
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        starts, ends = edge[::2], edge[1::2]
        self.data = data
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * power[:len(data)], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * inverse[starts]
                    + (ends - starts).astype(np.uint64))
        rows = np.searchsorted(np.cumsum(sizes), starts, "right")
        counts = np.bincount(rows, minlength=len(texts))
        first = np.cumsum(counts) - counts
        take = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        self.row = np.repeat(np.arange(len(texts)), take)
        at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + first[self.row]
        length = np.minimum(width, counts)[self.row]
        total = np.zeros(len(at), np.uint64)
        for k in range(width):
            here = k < length
            word = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else total
            total = np.where(here, (total + word) * _Q, total)
        self.hash = mix(total + length.astype(np.uint64))
        self.start = starts[at] if len(at) else at
        self.end = ends[at + length - 1] if len(at) else at

    def text(self, index: int) -> str:
        """The shingle's folded words, joined by single blanks."""
        raw = self.data[self.start[index]:self.end[index]].tobytes()
        return " ".join(w.decode("utf-8", "replace") for w in raw.split(b"\0") if w)
