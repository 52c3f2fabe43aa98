"""Adaptive context-mixing range coder for token ids.

A stream begins with a table over all its ids: the distinct ones with their frequencies
(order 0), and for ids that mostly go on alike the id that follows most and how often it
does (order 1). The rest is cut into blocks of ``block`` ids. Each block starts from
that table and fresh adaptive states, has a checksum and can be decoded alone. Blocks
advance side by side: one step codes one id in every block, as array operations over all.

An id's probability mixes three predictions: what came last after the same two ids in this
block (order 2), the table's successor of the last id (order 1), and the table's
frequencies (order 0). The weights of the first two adapt after every id; they are kept
by how often the order-2 guess has held, how sure the successor is, and whether both
name the same id. The range coder (64 bits, carries into words already out, 32 bits at
a time) takes the choice among the three, then the id by its frequency where order 0 is
chosen. The range is refilled once an id (twice where a stream has so many distinct ids
that one refill would leave it too small). All arithmetic that decides is on integers, so
that every machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
SLOTS = 2048
#: Bits of the mixing weights and least bits of the frequencies.
MIX, FREQ = 16, 20
LOW = U(1 << 32)
HEAD = struct.Struct("<4sIIQII")
MAGIC = b"IDC3"
#: Upper ends of the classes by which successors are told apart, and what each class begins with.
SURE = np.array([0.05, 0.1, 0.2, 0.4, 0.7, 0.9])
BEGIN = np.array([0, 4500, 9200, 18400, 36000, 52000, 62000], np.int64)
LEAST_SEEN = 6


class Table:
    """Distinct ids with frequencies that sum to ``1 << bits``, and successors (-1: none) with their classes."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, successor: np.ndarray, sure: np.ndarray):
        self.ids, self.counts, self.successor, self.sure = ids, counts, successor, sure
        self.bits = bits_for(len(ids))
        self.freq = scaled(counts, self.bits)
        self.start = np.r_[0, np.cumsum(self.freq)[:-1]].astype(np.int64) if len(ids) else np.empty(0, np.int64)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Table, np.ndarray]:
        """The table of a stream, and the stream as places in it."""
        if not len(ids):
            none = np.empty(0, np.int64)
            return cls(none, none, none, none), none.astype(np.int32)
        if int(ids.max()) < 1 << 22:
            count = np.bincount(ids)
            distinct = np.flatnonzero(count)
            place = np.zeros(len(count), np.int32)
            place[distinct] = np.arange(len(distinct))
            rank, counts = place[ids], count[distinct]
        else:
            distinct, rank, counts = np.unique(ids, return_inverse=True, return_counts=True)
            rank = rank.astype(np.int32)
        n = len(distinct)
        wide = np.uint32 if n < 1 << 16 else np.uint64
        pairs = rank[:-1].astype(wide)
        pairs *= wide(n)
        pairs += rank[1:].astype(wide)
        pairs.sort()
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, np.int64)
        times, pair = np.diff(np.r_[first, len(pairs)]), pairs[first].astype(np.int64)
        del pairs
        successor, sure = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if len(pair):
            context = pair // n
            group = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            best = np.maximum.reduceat(times << 32 | np.arange(len(times)), group)
            seen = np.add.reduceat(times, group)
            kind = np.searchsorted(SURE, (best >> 32) / seen, side="right")
            good = (kind > 0) & (seen >= LEAST_SEEN)
            of = context[group][good]
            successor[of], sure[of] = (pair % n)[best[good] & 0xFFFFFFFF], kind[good]
        return cls(distinct, np.minimum(counts, (1 << 32) - 1), successor, sure), rank

    def packed(self) -> bytes:
        """The table as columns: steps between ids, frequencies, and for each id with a successor its class and successor."""
        steps = np.diff(self.ids, prepend=0)
        named = self.sure > 0
        columns = (shortest(steps), shortest(self.counts), self.sure.astype(np.uint8).tobytes(), shortest(self.successor[named]))
        return zlib.compress(struct.pack("<I", len(self.ids)) + b"".join(columns), 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        (n,), at = struct.unpack_from("<I", raw), 4
        steps, at = longest(raw, at, n)
        counts, at = longest(raw, at, n)
        sure = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        named, _ = longest(raw, at + n, int((sure > 0).sum()))
        successor = np.full(n, -1, np.int64)
        successor[sure > 0] = named
        return cls(np.cumsum(steps), counts, successor, sure)


def bits_for(distinct: int) -> int:
    return max(FREQ, min(28, distinct.bit_length() + 3))


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to ``1 << bits``, in proportion to counts and 1 at least."""
    if not len(counts):
        return np.empty(0, np.int64)
    room, total = (1 << bits) - len(counts), int(counts.sum())
    out = 1 + (counts.astype(float) * (room / total)).astype(np.int64)
    out[int(counts.argmax())] += (1 << bits) - int(out.sum())
    return out


def shortest(values: np.ndarray) -> bytes:
    """Bytes of values in planes, most significant last: low planes press badly, high ones are nearly all zero."""
    return b"".join((values >> shift & 255).astype(np.uint8).tobytes() for shift in (0, 8, 16, 24))


def longest(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24, at + 4 * n


#: Numbers that each step needs, as numpy's own, which saves turning them into such at every use.
HASH_LAST, HASH_BEFORE, SLOT_MASK, BITS_OF_TRUST, THREE, SEVEN, HALF, LOW_HALF, MOST_GUESSED = map(np.int64, (40503, 52711, SLOTS - 1, 2, 3, 7, 16, 65535, 65400))
#: The least that the weights of the order-2 and the order-1 guess come to, how far above it they go, and how fast they adapt.
TWO_LEAST, TWO_SPAN, TWO_RATE, ONE_LEAST, ONE_SPAN, ONE_RATE = map(np.int64, (64, 62936, 5, 64, 65471, 6))
#: Steps of trust, by trust: where the guess didn't hold, and (4 more) where it did.
TRUSTED = np.array([0, 0, -1, -1, 1, 1, 1, 0], np.int64)
ALL, UMIX = np.int64(1 << MIX), U(MIX)


class Mixer:
    """Adaptive states of ``lanes`` blocks that advance side by side."""

    def __init__(self, table: Table, lanes: int):
        self.slot, self.state = np.arange(lanes) * SLOTS, np.arange(lanes) * 64
        # A guess (-2: none yet, which is no id and no successor) and two bits of trust in it.
        self.guess = np.full(lanes * SLOTS, -8, np.int32)
        # By trust of order 2 (4), class of order 1 (8) and agreement (2): chance that the order-2 guess holds (16 bits), and above it that else the order-1 guess does.
        two = np.repeat(np.array([0, 9000, 30000, 50000], np.int64), 8)
        one = np.tile(np.r_[BEGIN, 0], 4)
        two, one = np.r_[two, np.minimum(two + 6000, 60000)], np.r_[one, np.zeros(32, np.int64)]
        self.chances = np.tile(np.maximum(two, TWO_LEAST) | np.maximum(one, ONE_LEAST) << 16, lanes)
        # Before the first id there is no context: one place more in the successors. Below them, in three bits, their classes.
        self.successor = np.r_[table.successor, -1] << 3 | np.r_[table.sure, 0]
        self.last = self.before = np.full(lanes, len(table.ids), np.int64)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares (of 65,536) of the order-2 guess, and of both guesses; the rest is order 0's."""
        at = self.last * HASH_LAST
        at += self.before * HASH_BEFORE
        at >>= THREE
        at &= SLOT_MASK
        at += self.slot
        self.at, self.held = at, self.guess.take(at)
        held = self.held.astype(np.int64)
        self.g2, self.t2 = held >> BITS_OF_TRUST, held & THREE
        next_ = self.successor.take(self.last, mode="wrap")
        self.g1 = next_ >> THREE
        here = (self.g1 == self.g2).astype(np.int64)
        here <<= BITS_OF_TRUST
        here += self.t2
        here <<= THREE
        next_ &= SEVEN
        here += next_
        here += self.state
        self.here, self.chance = here, self.chances.take(here)
        self.p2, self.p1 = self.chance & LOW_HALF, self.chance >> HALF
        both = MOST_GUESSED - self.p2
        both *= self.p1
        both >>= HALF
        both += self.p2
        return self.p2, both

    def learn(self, ids: np.ndarray, by_two: np.ndarray, by_one: np.ndarray) -> None:
        """``by_two``, ``by_one``: all bits set where the order-2 guess was coded, and the order-1 guess; else order 0."""
        step = by_one & ONE_SPAN
        step -= self.p1
        step += ONE_LEAST
        step >>= ONE_RATE
        step &= ~by_two
        step <<= HALF
        self.chance += step
        step = by_two & TWO_SPAN
        step -= self.p2
        step += TWO_LEAST
        step >>= TWO_RATE
        self.chance += step
        self.chances[self.here] = self.chance
        # Trust goes up to 3 by what held, else down; a guess that had 1 at most gives way to the id.
        guess = TRUSTED.take(self.t2 - (by_two << BITS_OF_TRUST)) + self.held
        fresh = (self.t2 < BITS_OF_TRUST) & (by_two == 0)
        np.copyto(guess, ids << BITS_OF_TRUST | 1, where=fresh)
        self.guess[self.at] = guess
        self.before, self.last = self.last, ids


def steps_of(table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the ids' parts of order 0, and last the whole of it, for ids that a guess has named."""
    return np.r_[table.start, 0].astype(U), np.r_[table.freq, 1 << table.bits].astype(U)


def encoded_blocks(table: Table, ranks: np.ndarray) -> list[bytes]:
    """The blocks (columns of ``ranks``) as bytes."""
    steps, lanes = ranks.shape
    mixer, room, bits = Mixer(table, lanes), steps // 2 + 64, U(table.bits)
    low, wide = np.zeros(lanes, U), np.full(lanes, ~U(0), U)
    words, count, row = np.zeros((lanes, room), np.uint32), np.zeros(lanes, np.int64), np.arange(lanes)
    (start0, freq0), whole, twice = steps_of(table), np.int64(len(table.ids)), table.bits > FREQ

    def carry(rows: np.ndarray) -> None:
        at = count[rows] - 1
        while len(rows):
            words[rows, at] += np.uint32(1)
            more = words[rows, at] == 0
            rows, at = rows[more], at[more] - 1

    def out(add: np.ndarray) -> None:
        nonlocal words, low
        low = low + add
        over = np.flatnonzero(low < add)
        if len(over):
            carry(over)
        rows = np.flatnonzero(wide < LOW)
        if len(rows):
            at, some = count[rows], low[rows]
            if int(at.max()) + 2 >= words.shape[1]:
                words = np.concatenate([words, np.zeros_like(words)], axis=1)
            words[rows, at] = some >> U(32)
            count[rows] = at + 1
            low[rows] = some << U(32)
            wide[rows] <<= U(32)

    for step in range(steps):
        now = ranks[step].astype(np.int64)
        a, ab = mixer.weights()
        # All bits set where true: as fast as a product, and much faster than a choice by truth values that no one can foresee.
        by_two = -(now == mixer.g2).astype(np.int64)
        by_one = -(now == mixer.g1).astype(np.int64) & ~by_two
        by_none = ~(by_two | by_one)
        begin = (a & by_one) | (ab & by_none)
        size = (a & by_two) | ((ab - a) & by_one) | ((ALL - ab) & by_none)
        part = wide >> UMIX
        add, wide = part * begin.view(U), part * size.view(U)
        if twice:
            out(add)
            add = U(0)
        place = (now & by_none) | (whole & ~by_none)
        part = wide >> bits
        wide = part * freq0.take(place)
        out(add + part * start0.take(place))
        mixer.learn(now, by_two, by_one)
    # One word more names a point inside every interval, which is at least a word wide.
    point = low + (wide - U(1))
    carry(row[point < low])
    words[row, count] = (point >> U(32)).astype(np.uint32)
    return [words[k, : n + 1].astype("<u4").tobytes() for k, n in enumerate(count.tolist())]


def decoded_blocks(table: Table, data: list[bytes], steps: int) -> np.ndarray:
    """Places in the table of all ids of the blocks, a column each."""
    lanes, mixer, bits = len(data), Mixer(table, len(data)), U(table.bits)
    room = max(len(d) for d in data) // 4 + 4
    words = np.zeros((lanes, room), U)
    for k, d in enumerate(data):
        words[k, : len(d) // 4] = np.frombuffer(d, "<u4")
    ends = np.arange(lanes) * room
    words = words.ravel()
    # ``ahead`` is how far the coded point lies above the interval's low end.
    ahead, wide, at = words[ends] << U(32) | words[ends + 1], np.full(lanes, ~U(0), U), ends + 2
    last = ends + room - 1
    place = np.repeat(np.arange(len(table.ids)), table.freq)
    (start0, freq0), whole, twice = steps_of(table), np.int64(len(table.ids)), table.bits > FREQ
    out = np.zeros((steps, lanes), np.int32)

    def take() -> None:
        rows = np.flatnonzero(wide < LOW)
        if len(rows):
            here = at[rows]
            ahead[rows] = ahead[rows] << U(32) | words[np.minimum(here, last[rows])]
            wide[rows] <<= U(32)
            at[rows] = here + 1

    for step in range(steps):
        a, ab = mixer.weights()
        part = wide >> UMIX
        upto_two, upto_one = part * a.view(U), part * ab.view(U)
        none = ahead >= upto_one
        by_two, by_none = -(ahead < upto_two).astype(np.int64), -none.astype(np.int64)
        by_one = ~(by_two | by_none)
        begin = (upto_one & by_none.view(U)) | (upto_two & by_one.view(U))
        wide = ((part << UMIX) & by_none.view(U)) | (upto_one & by_one.view(U)) | (upto_two & by_two.view(U))
        wide -= begin
        ahead = ahead - begin
        if twice:
            take()
        part = wide >> bits
        # The quotient of floats may be one off at an edge of a part; that shows, and whole numbers settle it.
        ids = place.take((ahead / part).astype(np.int64), mode="clip")
        now = (ids & by_none) | (whole & ~by_none)
        rest, wide = ahead - part * start0.take(now), part * freq0.take(now)
        off = np.flatnonzero((rest >= wide) & none)
        if len(off):
            ids[off] = place.take((ahead[off] // part[off]).astype(np.int64), mode="clip")
            rest[off] = ahead[off] - part[off] * start0[ids[off]]
            wide[off] = part[off] * freq0[ids[off]]
        ahead = rest
        take()
        now = (ids & by_none) | (mixer.g2 & by_two) | (mixer.g1 & by_one)
        out[step] = now
        mixer.learn(now, by_two, by_one)
    return out


def encode(ids: np.ndarray, block: int = 2048, lanes: int = 2048) -> bytes:
    """A stream: header, table, for every block its bytes' length and its ids' checksum, then the blocks."""
    if len(ids) and (int(ids.max()) >= 1 << 32 or int(ids.min()) < 0):
        raise ValueError("ids are unsigned numbers of 32 bits")
    table, ranks = Table.of(ids)
    blocks = -(-len(ids) // block)
    # The last block is filled up with what codes shortest after anything, the most frequent id.
    filler = int(table.counts.argmax()) if len(table.counts) else 0
    rows = np.r_[ranks, np.full(blocks * block - len(ids), filler, np.int32)].reshape(blocks, block)
    del ranks
    data: list[bytes] = []
    for at in range(0, blocks, lanes):
        data += encoded_blocks(table, np.ascontiguousarray(rows[at : at + lanes].T))
    names = table.ids.astype("<u4")
    index = b"".join(struct.pack("<II", len(d), zlib.crc32(names[r].tobytes())) for d, r in zip(data, rows))
    packed = table.packed()
    return HEAD.pack(MAGIC, block, blocks, len(ids), len(packed), zlib.crc32(packed)) + packed + index + b"".join(data)


def decode(stream: bytes, lanes: int = 2048) -> np.ndarray:
    """The ids; raises ValueError where the table or a block fails its checksum."""
    magic, block, blocks, n, size, check = HEAD.unpack_from(stream)
    if magic != MAGIC:
        raise ValueError("not an id stream")
    packed, at = stream[HEAD.size : HEAD.size + size], HEAD.size + size
    if zlib.crc32(packed) != check:
        raise ValueError("the table fails its checksum")
    if len(stream) < at + 8 * blocks:
        raise ValueError("the stream is cut off")
    table, index = Table.unpacked(packed), np.frombuffer(stream, "<u4", 2 * blocks, at).reshape(-1, 2)
    starts = at + 8 * blocks + np.r_[0, np.cumsum(index[:, 0], dtype=np.int64)]
    if len(stream) < starts[-1]:
        raise ValueError("the stream is cut off")
    out, names = np.zeros((blocks, block), np.uint32), table.ids.astype("<u4")
    for k in range(0, blocks, lanes):
        data = [stream[a:b] for a, b in zip(starts[k : k + lanes], starts[k + 1 : k + lanes + 1])]
        out[k : k + len(data)] = names[decoded_blocks(table, data, block)].T
    for k in range(blocks):
        if zlib.crc32(out[k].astype("<u4").tobytes()) != index[k, 1]:
            raise ValueError(f"block {k} fails its checksum")
    return out.reshape(-1)[:n]
