"""Adaptive context-mixing range coder for token ids, many blocks in step.

A segment holds a sorted dictionary of its ids and independently reset blocks of
``BLOCK`` ids. All blocks of a segment are coded in step, one numpy lane a block.

Each lane mixes three predictions of the next id: the one that followed the last
two ids (order 2), the one that followed the last id (order 1), and adaptive
frequencies (order 0). Each context counts how often it was right of late; both
counts together set the weights of the mixture. The range coder keeps 48-bit
ranges and writes 16-bit words.
"""

import struct
import zlib

import numpy as np

MAGIC = b"PFRC"
BLOCK, LANES = 1024, 2048
SLOTS = 512            # entries of each lane's order-1 and order-2 tables
SINGLE, SHIFT = 256, 6  # frequent ids have a class of their own, others share one of 64
PRECISION = 12         # bits of the order-0 frequencies
REBUILD, GAIN = 256, 24  # ids between two order-0 updates, weight of each id
MIX = 12               # bits of the mixing weights
SCALE = PRECISION + SHIFT + MIX

_U = np.uint64


def _weights():
    """Mixing weights of order 2 and order 1 by both confidences; the rest is order 0's."""
    two = np.array([0, 700, 1500, 2300, 2900, 3300, 3600, 3800])
    one = np.array([0, 300, 700, 1200, 1700, 2200, 2700, 3100])
    q2 = np.repeat(two, 8)
    q1 = (4096 - q2) * np.tile(one, 8) // 4096
    q1 = np.minimum(q1, 4032 - q2)
    return q2, q1


_Q2, _Q1 = _weights()
_EDGE2, _SIZE1 = _Q2 << (SCALE - MIX), _Q1 << (SCALE - MIX)
_EDGE1, _UNIT = _EDGE2 + _SIZE1, 4096 - _Q2 - _Q1


# Change of confidence (0 to 7) after a miss and after a hit; _NEW: forget the prediction.
_NEW = 99
_STEP = np.array([_NEW] * 3 + [-2] * 5 + [1] * 7 + [0], np.int32)


class _Model:
    """State of all lanes: both tables and the order-0 frequencies."""

    def __init__(self, lanes: int, symbols: int):
        self.lanes = np.arange(lanes)
        self.classes = min(symbols, SINGLE) + max(0, -(-(symbols - SINGLE) // (1 << SHIFT)))
        self.base = self.lanes * SLOTS
        # Prediction << 3 | confidence.
        self.two = np.full(lanes * SLOTS, -8, np.int32)
        self.one = np.full(lanes * SLOTS, -8, np.int32)
        self.h1 = np.zeros(lanes, np.int64)
        self.h2 = np.zeros(lanes, np.int64)
        place = np.arange(self.classes)
        rank = np.where(place < SINGLE, place, SINGLE + ((place - SINGLE) << SHIFT))
        prior = np.where(place < SINGLE, 1, 1 << SHIFT) * 2400.0 / (rank + 12)
        self.counts = np.tile(prior.astype(np.int32) + 1, lanes)
        self.row = self.lanes * self.classes
        self.steps, self.built = 0, None
        self.rebuild()

    def rebuild(self):
        counts = self.counts.reshape(len(self.lanes), -1)
        room = (1 << PRECISION) - self.classes
        factor = np.float32(room) / counts.sum(1, dtype=np.int64).astype(np.float32)
        share = (counts.astype(np.float32) * (factor * np.float32(0.9999))[:, None]).astype(np.int64)
        share += 1
        floor = np.cumsum(share, axis=1)
        share[:, -1] += (1 << PRECISION) - floor[:, -1]  # what rounding left over
        floor -= share
        floor[:, -1] = (1 << PRECISION) - share[:, -1]
        self.share = share
        self.packed = ((floor << 16) | share).ravel()
        self.built = None

    def slots(self):
        """Class of each order-0 slot, for decoding."""
        if self.built is None:
            kinds = np.tile(np.arange(self.classes, dtype=np.uint16), len(self.lanes))
            self.built = np.repeat(kinds, self.share.ravel())
        return self.built

    def look(self):
        """Both predictions, and the place of their weights."""
        self.i2, self.i1 = self.h2 + self.base, self.h1 + self.base
        self.e2, self.e1 = self.two.take(self.i2), self.one.take(self.i1)
        self.c2, self.c1 = self.e2 & 7, self.e1 & 7
        p2, p1 = self.e2 >> 3, self.e1 >> 3
        # Where both agree order 2 speaks for them.
        return p2, p1, (self.c2 << 3) + self.c1 * (p1 != p2)

    def update(self, symbol, same2, same1, at):
        fresh = ((symbol << 3) | 1).astype(np.int32)
        for table, index, e, sure, same in ((self.two, self.i2, self.e2, self.c2, same2),
                                            (self.one, self.i1, self.e1, self.c1, same1)):
            step = _STEP.take(sure + (same << 3))
            table[index] = np.where(step == _NEW, fresh, e + step)
        self.counts[at] = self.counts.take(at) + GAIN
        mixed = symbol * 0x9E3B
        self.h2 = (mixed + self.h1 * 0x35) & (SLOTS - 1)
        self.h1 = (mixed >> 4) & (SLOTS - 1)
        self.steps += 1
        if self.steps % REBUILD == 0:
            self.rebuild()


def _class(symbol):
    big = symbol >= SINGLE
    rest = symbol - SINGLE
    return (np.where(big, SINGLE + (rest >> SHIFT), symbol),
            np.where(big, rest & ((1 << SHIFT) - 1), 0), np.where(big, 0, SHIFT))


def _carried(digits: np.ndarray) -> np.ndarray:
    """Digits of up to 17 bits as proper 16-bit words: carries move to the left."""
    digits = digits.astype(np.int64)
    while True:
        carry = digits >> 16
        if not carry.any():
            return digits.astype("<u2")
        digits &= 0xFFFF
        digits[:, :-1] += carry[:, 1:]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment: header, dictionary, word counts and checksums of blocks, words."""
    ids = np.asarray(ids, np.uint32)
    if not len(ids):
        return MAGIC + struct.pack("<III", 0, block, 0)
    if ids.max() < 1 << 20:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        order = np.lexsort((values, -counts[values]))  # frequent ids first
        rank = np.zeros(len(counts), np.int32)
        rank[values[order]] = np.arange(len(order))
        symbols = rank[ids]
    else:
        values, found, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((values, -counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        symbols = rank[found]
    lanes = -(-len(ids) // block)
    grid = np.zeros(lanes * block, np.int32)
    grid[:len(ids)] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    model = _Model(lanes, len(values))
    low, width = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
    digits = np.zeros((lanes, block * 2 + 4), np.uint32)
    used = np.zeros(lanes, np.int64)
    pitch = digits.shape[1]
    flat = digits.ravel()
    # The last block may be shorter; it codes padding, which decoding drops.
    for step in range(min(block, len(ids))):
        symbol = grid[step].astype(np.int64)
        kind, inner, shift = _class(symbol)
        p2, p1, state = model.look()
        same2, same1 = p2 == symbol, p1 == symbol
        at = model.row + kind
        packed = model.packed.take(at)
        freq = packed & 0xFFFF
        unit = _UNIT.take(state)
        start = (((packed >> 16) << SHIFT) + inner * freq) * unit + _EDGE1.take(state)
        size = (freq << shift) * unit
        either = np.flatnonzero(same2 | same1)
        if len(either):
            some, two = state[either], same2[either]
            start[either] = np.where(two, 0, _EDGE2[some])
            size[either] = np.where(two, _EDGE2[some], _SIZE1[some])
        width >>= _U(SCALE)
        low += start.view(_U) * width
        width *= size.view(_U)
        small = np.flatnonzero(width < _U(1 << 32))
        while len(small):
            part, place = low[small], used[small]
            flat[small * pitch + place] = part >> _U(32)
            low[small] = (part & _U(0xFFFFFFFF)) << _U(16)
            used[small] = place + 1
            part = width[small] << _U(16)
            width[small] = part
            small = small[part < _U(1 << 32)]
        model.update(symbol, same2, same1, at)
    for _ in range(3):  # the rest of the low end
        flat[np.arange(lanes) * pitch + used] = low >> _U(32)
        low = (low & _U(0xFFFFFFFF)) << _U(16)
        used += 1
    words = _carried(digits[:, :used.max()])
    keep = np.arange(words.shape[1]) < used[:, None]
    body = words[keep].tobytes()
    sums = np.array([zlib.crc32(ids[k * block:(k + 1) * block].astype("<u4").tobytes())
                     for k in range(lanes)], "<u4")
    table = zlib.compress(values[order].astype("<u4").tobytes())
    return b"".join([MAGIC, struct.pack("<IIII", len(ids), block, len(values), len(table)), table,
                     used.astype("<u2").tobytes(), sums.tobytes(), body])


def decode(data: bytes) -> np.ndarray:
    """The ids of one segment; ValueError where a block's checksum differs."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    count, block, symbols = struct.unpack_from("<III", data, 4)
    if not count:
        return np.zeros(0, np.uint32)
    table_size, = struct.unpack_from("<I", data, 16)
    at = 20
    values = np.frombuffer(zlib.decompress(data[at:at + table_size]), "<u4")
    at += table_size
    lanes = -(-count // block)
    used = np.frombuffer(data, "<u2", lanes, at).astype(np.int64)
    at += 2 * lanes
    sums = np.frombuffer(data, "<u4", lanes, at)
    at += 4 * lanes
    words = np.r_[np.frombuffer(data, "<u2", int(used.sum()), at), np.zeros(8, "<u2")].astype(_U)
    next_word = np.cumsum(used) - used
    code = np.zeros(lanes, _U)
    for _ in range(3):
        code = (code << _U(16)) | words[next_word]
        next_word += 1
    width = np.full(lanes, 1 << 48, _U)
    model = _Model(lanes, symbols)
    grid = np.zeros((block, lanes), np.int32)
    offset = model.lanes << PRECISION
    for step in range(min(block, count)):
        p2, p1, state = model.look()
        width >>= _U(SCALE)
        value = (code // width).view(np.int64)
        edge2, edge1, unit = _EDGE2.take(state), _EDGE1.take(state), _UNIT.take(state)
        inside = (value - edge1) // unit
        miss = inside >= 0
        slot = np.maximum(inside >> SHIFT, 0)
        kind = model.slots().take(slot + offset, mode="clip").astype(np.int64)
        at = model.row + kind
        packed = model.packed.take(at)
        freq, floor = packed & 0xFFFF, (packed >> 16) << SHIFT
        big = kind >= SINGLE
        inner = np.where(big, (inside - floor) // freq, 0)
        symbol = np.where(big, SINGLE + ((kind - SINGLE) << SHIFT) + inner, kind)
        start = (floor + inner * freq) * unit + edge1
        size = np.where(big, freq, freq << SHIFT) * unit
        either = np.flatnonzero(~miss)
        if len(either):
            two = value[either] < edge2[either]
            symbol[either] = np.where(two, p2[either], p1[either])
            start[either] = np.where(two, 0, edge2[either])
            size[either] = np.where(two, edge2[either], _SIZE1[state[either]])
            at[either] = model.row[either] + _class(symbol[either])[0]
        code -= start.view(_U) * width
        width *= size.view(_U)
        small = np.flatnonzero(width < _U(1 << 32))
        while len(small):
            place = next_word[small]
            code[small] = (code[small] << _U(16)) | words.take(place, mode="clip")
            next_word[small] = place + 1
            part = width[small] << _U(16)
            width[small] = part
            small = small[part < _U(1 << 32)]
        grid[step] = symbol
        model.update(symbol, p2 == symbol, p1 == symbol, at)
    flat = grid.T.ravel()[:count]
    if len(flat) and flat.max() >= symbols:
        raise ValueError("damaged token segment")
    ids = values[flat].astype(np.uint32)
    for k in range(lanes):
        if zlib.crc32(ids[k * block:(k + 1) * block].astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"checksum of block {k} differs")
    return ids
