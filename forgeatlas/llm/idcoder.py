"""Context-mixing range coder for token ids, many blocks at a time.

Ids are cut into blocks of ``BLOCK`` ids, and up to ``LANES`` blocks make a batch. A block
carries its own checksum and can be read alone with the head of its batch. Three predictors
are mixed into one distribution over all ids:

- order 0: how often each id occurs in the batch (written in the head, scaled to ``SHARES``);
- order 1 and order 2: the id that last followed the same one or two ids in the block (small
  tables), with a confidence that counts hits in a row. What a confidence is worth in the
  batch is written in the head and gives the weight of the predictor.

The blocks of a batch are the lanes of numpy arrays: step t codes id t of every block at
once. The range coder works on whole numbers below 2^53 in float64, where products, sums and
rounded-down quotients are exact, and gives out words of 24 bits; a carry is added to the
words before it when a batch is done.

``decode_first`` reads the blocks of version 1, which learned order 0 inside every block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
LANES = 2048
ALPHABET = 1 << 16
SLOTS = 512
LEVELS = 8
# Sum of the order-0 shares; a predictor weighs at most ``ODDS_MOST`` times as much.
SHARES = 1 << 18
ODDS_MOST = 30
# Ranges lie in [BOTTOM, BOTTOM * WORD).
WORD = float(1 << 24)
BOTTOM = float(1 << 28)
# Steps whose intervals are found together.
STRETCH = 16
_BATCH = struct.Struct("<III")
_BLOCK = struct.Struct("<III")
# Confidence after an id, by what it was; the last entry is for a miss.
_NEXT = np.array([1, 2, 3, 4, 5, 6, 7, 7, 1], np.int32)


class Model:
    """What the batch head says: order-0 shares and the weight of every confidence."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray, weights: np.ndarray):
        self.width = np.zeros(ALPHABET)
        self.width[ids] = shares
        self.start = np.cumsum(self.width) - self.width
        self.weights = weights.astype(np.float64)
        self.ids, self.shares = ids, shares

    def head(self, number: int) -> bytes:
        steps = np.diff(self.ids, prepend=0).astype("<u2")
        table = zlib.compress(steps.tobytes() + self.shares.astype("<u4").tobytes(), 6)
        table = self.weights.astype("<u4").tobytes() + table
        return _BATCH.pack(number, len(table), zlib.crc32(table, number)) + table

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[Model, int, int]:
        """Model, number of ids and end of the head at a place."""
        number, length, check = _BATCH.unpack_from(data, at)
        at += _BATCH.size
        table = bytes(data[at : at + length])
        if zlib.crc32(table, number) != check:
            raise ValueError("checksum of a batch head differs")
        weights = np.frombuffer(table, "<u4", 2 * LEVELS).reshape(2, LEVELS)
        raw = zlib.decompress(table[weights.nbytes :])
        known = len(raw) // 6
        ids = np.cumsum(np.frombuffer(raw, "<u2", known).astype(np.int64))
        return cls(ids, np.frombuffer(raw, "<u4", known, 2 * known), weights), number, at + length


def _shares(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, and shares of at least 1 that sum to ``SHARES``."""
    count = np.bincount(part, minlength=ALPHABET)
    ids = np.flatnonzero(count)
    count = count[ids]
    # Ids below one share take one; the others divide what is left.
    rare = count * SHARES < len(part)
    rest, whole = SHARES - int(rare.sum()), max(1, int(count[~rare].sum()))
    shares = np.where(rare, 1, np.maximum(1, count * rest // whole))
    order = np.argsort(-count, kind="stable")
    gap = SHARES - int(shares.sum())
    while gap:
        if gap > 0:
            shares[order[0]] += gap
            break
        some = order[shares[order] > 1][:-gap]
        shares[some] -= 1
        gap += len(some)
    return ids, shares


class _Followers:
    """Tables of orders 1 and 2 of some lanes. An entry is id * 8 + confidence."""

    def __init__(self, lanes: int):
        self.tables = [np.zeros(lanes * SLOTS, np.int32) for _ in range(2)]
        self.base = np.arange(lanes, dtype=np.int64) * SLOTS
        self.one = self.two = np.zeros(lanes, np.int64)

    def ask(self, n: int, out: tuple = (None, None)) -> tuple[np.ndarray, np.ndarray]:
        """Entries of both orders for the next id of the first ``n`` lanes."""
        one, two, base = self.one[:n], self.two[:n], self.base[:n]
        self.places = (one & (SLOTS - 1)) + base, ((one * 37 + two * 101) & (SLOTS - 1)) + base
        one, two = (x.take(at, out=o, mode="clip") for x, at, o in zip(self.tables, self.places, out, strict=True))
        return one, two

    def learn(self, ids: np.ndarray, scaled: np.ndarray, differ: tuple[np.ndarray, np.ndarray]) -> None:
        """``scaled`` is id * 8, ``differ`` its exclusive or with the entries."""
        for table, place, other in zip(self.tables, self.places, differ, strict=True):
            table[place] = scaled + _NEXT.take(np.minimum(other, LEVELS))
        self.two, self.one = self.one, ids


def _weights(entries: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Weight of each confidence of a predictor: its odds of a hit, in order-0 shares."""
    asked = np.bincount((entries & (LEVELS - 1)).ravel(), minlength=LEVELS)
    hit = np.bincount(differ[differ < LEVELS], minlength=LEVELS)
    odds = np.minimum((hit + 0.2) / (asked - hit + 0.8), ODDS_MOST)
    odds[0] = 0  # nothing was seen there
    return (odds * SHARES).astype(np.int64)


def _lanes_at(sizes: np.ndarray) -> np.ndarray:
    """Number of lanes of every step; all blocks but the last are equally long."""
    return len(sizes) - (np.arange(int(sizes[0])) >= sizes[-1])


def _encode_batch(part: np.ndarray) -> bytes:
    lanes = -(-len(part) // BLOCK)
    sizes = np.minimum(BLOCK, len(part) - BLOCK * np.arange(lanes))
    square = np.zeros((lanes, BLOCK), np.uint16)
    square.ravel()[: len(part)] = part
    ids = np.ascontiguousarray(square.T[: int(sizes[0])])
    steps, active = len(ids), _lanes_at(sizes)
    entries = np.zeros((2, steps, lanes), np.int32)
    followers = _Followers(lanes)
    for t in range(steps):
        n = active[t]
        scaled = ids[t, :n].astype(np.int32) << 3
        one, two = followers.ask(n, (entries[0, t, :n], entries[1, t, :n]))
        followers.learn(ids[t, :n].astype(np.int64), scaled, (one ^ scaled, two ^ scaled))
    # Every fourth step tells what the confidences are worth.
    scaled = ids[::4].astype(np.int32) << 3
    weights = np.stack([_weights(x, x ^ scaled) for x in entries[:, ::4]])
    model = Model(*_shares(part), weights)

    low, size = np.zeros(lanes), np.full(lanes, BOTTOM * WORD)
    words = np.zeros((lanes, int(sizes[0]) + 2), np.uint32)
    flat, at = words.ravel(), np.arange(lanes, dtype=np.int64) * words.shape[1]
    for first in range(0, steps, STRETCH):
        some = slice(first, min(first + STRETCH, steps))
        scaled, own = ids[some].astype(np.int32) << 3, ids[some].astype(np.int64)
        start, width = model.start.take(own), model.width.take(own)
        whole = np.full(start.shape, float(SHARES))
        for k in range(2):
            extra = model.weights[k].take(entries[k, some] & (LEVELS - 1))
            start += extra * (entries[k, some] < scaled)
            width += extra * ((entries[k, some] ^ scaled) < LEVELS)
            whole += extra
        for t in range(first, some.stop):
            n, k = active[t], t - first
            step = np.floor(size[:n] / whole[k, :n])
            low[:n] += step * start[k, :n]
            np.multiply(step, width[k, :n], out=size[:n])
            due = (size[:n] < BOTTOM).nonzero()[0]
            if len(due):
                place, value = at[due], low[due]
                word = np.floor(value * (1 / BOTTOM))
                flat[place] = word
                at[due] = place + 1
                low[due] = (value - word * BOTTOM) * WORD
                size[due] *= WORD
    # The next whole word above ``low`` lies in the range; what follows it reads as zero.
    flat[at] = np.ceil(low / BOTTOM)
    lengths = at - np.arange(lanes, dtype=np.int64) * words.shape[1] + 1
    while (over := words >> 24).any():
        words &= 0xFFFFFF
        words[:, :-1] += over[:, 1:]
    packed = words.astype("<u4").view(np.uint8).reshape(lanes, -1, 4)[:, :, :3]
    out = [model.head(len(part))]
    for k in range(lanes):
        check = zlib.crc32(part[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes())
        payload = packed[k, : lengths[k]].tobytes()
        out += _BLOCK.pack(int(sizes[k]), check, len(payload)), payload
    return b"".join(out)


def _decode_lanes(model: Model, payloads: list[memoryview], sizes: np.ndarray) -> np.ndarray:
    lanes, steps, active = len(sizes), int(sizes[0]), _lanes_at(sizes)
    longest = max(map(len, payloads)) // 3 + 4
    padded = np.zeros((lanes, longest, 4), np.uint8)
    for k, payload in enumerate(payloads):
        some = len(payload) // 3
        padded[k, :some, :3] = np.frombuffer(payload, np.uint8, 3 * some).reshape(some, 3)
    words = padded.view("<u4")[:, :, 0]
    # A range has 52 bits, which is two words and 4 bits of the third.
    code = words[:, 0] * BOTTOM + words[:, 1] * float(1 << 4) + (words[:, 2] >> 20)
    follow = ((words[:, 2:-1] << 4) & 0xFFFFFF | words[:, 3:] >> 20).astype(np.float64)
    flat, at = follow.ravel(), np.arange(lanes, dtype=np.int64) * follow.shape[1]
    last = len(flat) - 1
    size = np.full(lanes, BOTTOM * WORD)
    owner = np.repeat(model.ids, model.shares)
    width_of, start_of, (first, second) = model.width, model.start, model.weights
    followers, out = _Followers(lanes), np.zeros((steps, lanes), np.uint16)
    for t in range(steps):
        n = active[t]
        one, two = followers.ask(n)
        extra_one, extra_two = first.take(one & (LEVELS - 1)), second.take(two & (LEVELS - 1))
        extra = extra_one + extra_two
        whole = extra + SHARES
        step = np.floor(size[:n] / whole)
        value = np.floor(code[:n] / step)
        np.minimum(value, whole - 1, out=value)
        # Take the weights of the two guesses out of the value, the lower guess first.
        extra_low = np.where(one <= two, extra_one, extra_two)
        for entry, weight in ((np.minimum(one, two), extra_low), (np.maximum(one, two), extra - extra_low)):
            np.minimum(value, np.maximum(start_of.take(entry >> 3), value - weight), out=value)
        ids = owner.take(value.astype(np.int64))
        out[t, :n] = ids
        scaled = (ids << 3).astype(np.int32)
        differ = one ^ scaled, two ^ scaled
        start = start_of.take(ids)
        start += extra_one * (one < scaled)
        start += extra_two * (two < scaled)
        width = width_of.take(ids)
        width += extra_one * (differ[0] < LEVELS)
        width += extra_two * (differ[1] < LEVELS)
        code[:n] -= step * start
        np.multiply(step, width, out=size[:n])
        due = (size[:n] < BOTTOM).nonzero()[0]
        if len(due):
            place = at[due]
            code[due] = code[due] * WORD + flat.take(np.minimum(place, last))
            at[due] = place + 1
            size[due] *= WORD
        followers.learn(ids, scaled, differ)
    return out


def encode(ids: np.ndarray) -> bytes:
    """Batches of an id sequence: a head, and for each block a head (ids, checksum, bytes) and
    its payload."""
    if len(ids) and int(ids.max()) >= ALPHABET:
        raise ValueError("ids must be below 65536")
    return b"".join(_encode_batch(ids[at : at + BLOCK * LANES]) for at in range(0, len(ids), BLOCK * LANES))


def decode(data: bytes) -> np.ndarray:
    """Ids of encoded batches; a head or block whose checksum differs is an error."""
    data, at, out = memoryview(data), 0, []
    while at < len(data):
        model, number, at = Model.read(data, at)
        heads, payloads = [], []
        for _ in range(-(-number // BLOCK)):
            heads.append(_BLOCK.unpack_from(data, at))
            at += _BLOCK.size
            payloads.append(data[at : at + heads[-1][2]])
            at += heads[-1][2]
        sizes = np.array([head[0] for head in heads])
        if (sizes != np.minimum(BLOCK, number - BLOCK * np.arange(len(sizes)))).any():
            raise ValueError("blocks of a batch differ from its head")
        ids = np.ascontiguousarray(_decode_lanes(model, payloads, sizes).T.astype("<u4"))
        for k, (size, check, _) in enumerate(heads):
            if zlib.crc32(ids[k, :size]) != check:
                raise ValueError("checksum of a block differs")
        out.append(ids.ravel()[:number])
    return np.concatenate(out) if out else np.zeros(0, "<u4")


# Version 1: every block learned order 0 itself, by groups of 64 ids whose shares were brought
# up to date at fixed places; a carry-free range coder on 64 bits with words of 16 bits.
FIRST_LANES = 4096
GROUP = 6
GROUPS = ALPHABET >> GROUP
GAIN = 12
TOP = np.uint64(1 << 48)
CUT = np.uint64(1 << 32)
_U = np.uint64
REFRESH = {8, 16, 32, 64, 96} | set(range(128, BLOCK, 64))
# Weight (in 1/256 of the order-0 total) for a chance in 1/256.
ODDS = np.array([min(256 * 63, 256 * p // (256 - p)) for p in range(256)], np.int64)


class Lanes:
    """Model and coder state of some blocks of version 1; the first ``n`` lanes are in use."""

    def __init__(self, lanes: int):
        k = np.arange(GROUPS)
        self.count = np.tile(np.maximum(1, 400 // (k + 6)).astype(np.int64), (lanes, 1))
        self.cumulative = np.zeros((lanes, GROUPS + 1), np.int64)
        self.base = np.arange(lanes, dtype=np.int64) << 40
        self.tables = [np.zeros(lanes * SLOTS, np.int32) for _ in range(2)]
        self.worth = [np.zeros(lanes * LEVELS, np.int32) for _ in range(2)]
        for worth in self.worth:
            worth.reshape(lanes, LEVELS)[:, 1:] = 20000
        self.slot_base = np.arange(lanes, dtype=np.int64) * SLOTS
        self.level_base = np.arange(lanes, dtype=np.int64) * LEVELS
        self.count_base = np.arange(lanes, dtype=np.int64) * GROUPS
        self.cum_base = np.arange(lanes, dtype=np.int64) * (GROUPS + 1)
        self.last = [np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)]
        self.low = np.zeros(lanes, _U)
        self.range = np.full(lanes, ~_U(0), _U)
        self.refresh(lanes)

    def refresh(self, n: int) -> None:
        np.cumsum(self.count[:n], axis=1, out=self.cumulative[:n, 1:])
        self.cumulative[:n] += self.base[:n, None]
        self.cumulative[:n, 0] = self.base[:n]
        self.total = (self.cumulative[:n, -1] - self.base[:n]) << GROUP

    def predict(self, n: int) -> None:
        one, two = self.last[0][:n], self.last[1][:n]
        self.slots = [
            self.slot_base[:n] + ((one * 40503 >> 4) & (SLOTS - 1)),
            self.slot_base[:n] + (((one * 31 + two) * 2654435761 >> 12) & (SLOTS - 1)),
        ]
        self.guess, self.level, self.extra = [], [], []
        total = self.total[:n]
        for table, worth, slot in zip(self.tables, self.worth, self.slots, strict=True):
            entry = table[slot]
            level = self.level_base[:n] + (entry >> 16)
            self.guess.append((entry & 0xFFFF).astype(np.int64))
            self.level.append(level)
            self.extra.append(total * ODDS[worth[level] >> 8] >> 8)
        self.whole = total + self.extra[0] + self.extra[1]

    def share(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Order-0 start and width of ids."""
        at = self.cum_base[:n] + (ids >> GROUP)
        flat = self.cumulative.ravel()
        low = flat[at]
        width = flat[at + 1] - low
        return ((low - self.base[:n]) << GROUP) + (ids & ((1 << GROUP) - 1)) * width, width

    def group_of(self, units: np.ndarray, n: int) -> np.ndarray:
        """The order-0 group that holds a place, by halves of the lane's own shares."""
        flat, at = self.cumulative.ravel(), self.cum_base[:n].copy()
        half = GROUPS >> 1
        while half:
            at += half * (flat[at + half] <= units)
            half >>= 1
        return at - self.cum_base[:n]

    def learn(self, ids: np.ndarray, n: int, t: int) -> None:
        self.count.ravel()[self.count_base[:n] + (ids >> GROUP)] += GAIN
        for table, worth, slot, guess, level in zip(
            self.tables, self.worth, self.slots, self.guess, self.level, strict=True
        ):
            confidence = level - self.level_base[:n]
            hit = (guess == ids) & (confidence > 0)
            old = worth[level]
            worth[level] = old + (((hit * 65280) - old) >> 4) * (confidence > 0)
            grown = np.where(hit, np.minimum(confidence + 1, LEVELS - 1), np.where(confidence > 2, confidence >> 1, 1))
            kept = np.where(hit | (confidence <= 2), ids, guess)
            table[slot] = (kept | grown << 16).astype(np.int32)
        self.last[1][:n] = self.last[0][:n]
        self.last[0][:n] = ids
        if t + 1 in REFRESH:
            self.refresh(n)

    def narrow(self, start: np.ndarray, width: np.ndarray, step: np.ndarray, n: int) -> None:
        self.low[:n] += step * start.astype(_U)
        self.range[:n] = step * width.astype(_U)

    def full(self, n: int) -> np.ndarray | None:
        """Lanes that must give out a word now; ranges that straddle are cut first."""
        low, size = self.low[:n], self.range[:n]
        same = (low ^ (low + size)) < TOP
        short = ~same & (size < CUT)
        if short.any():
            size[short] = (~low[short] + _U(1)) & (CUT - _U(1))
        due = np.flatnonzero(same | short)
        return due if len(due) else None

    def shift(self, due: np.ndarray) -> None:
        self.low[due] <<= _U(16)
        self.range[due] <<= _U(16)


def _decode_first_lanes(payloads: list[bytes], sizes: np.ndarray) -> np.ndarray:
    lanes = len(sizes)
    state = Lanes(lanes)
    longest = max(map(len, payloads)) // 2 + 4
    words = np.zeros((lanes, longest), _U)
    for k, payload in enumerate(payloads):
        words[k, : len(payload) // 2] = np.frombuffer(payload, "<u2")
    code = np.zeros(lanes, _U)
    for k in range(4):
        code = code << _U(16) | words[:, k]
    at = np.full(lanes, 4, np.int64)
    out = np.zeros((int(sizes[0]), lanes), np.int64)
    with np.errstate(over="ignore"):
        for t in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t, "left"))
            state.predict(n)
            step = state.range[:n] // state.whole.astype(_U)
            value = np.minimum(((code[:n] - state.low[:n]) // step).astype(np.int64), state.whole - 1)
            # Take the weights of the two guesses out of the value, the lower guess first.
            g, e = state.guess, state.extra
            swap = g[0] > g[1]
            lower, upper = np.where(swap, g[1], g[0]), np.where(swap, g[0], g[1])
            equal = g[0] == g[1]
            less = np.where(equal, e[0] + e[1], np.where(swap, e[1], e[0]))
            more = np.where(equal, 0, np.where(swap, e[0], e[1]))
            for guess, extra in ((lower, less), (upper, more)):
                start, _ = state.share(guess, n)
                value = np.minimum(value, np.maximum(start, value - extra))
            group = state.group_of((value >> GROUP) + state.base[:n], n)
            inside = value - ((state.cumulative.ravel()[state.cum_base[:n] + group] - state.base[:n]) << GROUP)
            first = group << GROUP
            start, width = state.share(first, n)
            current = first + inside // width
            out[t, :n] = current
            start, width = state.share(current, n)
            for guess, extra in zip(g, e, strict=True):
                start += extra * (guess < current)
                width = width + extra * (guess == current)
            state.narrow(start, width, step, n)
            while (due := state.full(n)) is not None:
                code[due] = code[due] << _U(16) | words[due, np.minimum(at[due], longest - 1)]
                at[due] += 1
                state.shift(due)
            state.learn(current, n, t)
    return out


def decode_first(data: bytes) -> np.ndarray:
    """Ids of blocks of version 1; a block whose checksum differs is an error."""
    heads, at = [], 0
    while at < len(data):
        size, check, length = struct.unpack_from("<III", data, at)
        heads.append((size, check, data[at + 12 : at + 12 + length]))
        at += 12 + length
    out = []
    for k in range(0, len(heads), FIRST_LANES):
        part = heads[k : k + FIRST_LANES]
        order = sorted(range(len(part)), key=lambda i: -part[i][0])
        sizes = np.array([part[i][0] for i in order])
        ids = _decode_first_lanes([part[i][2] for i in order], sizes).T
        blocks: list = [None] * len(part)
        for lane, i in enumerate(order):
            blocks[i] = ids[lane, : sizes[lane]].astype("<u4")
            if zlib.crc32(blocks[i].tobytes()) != part[i][1]:
                raise ValueError("checksum of a block differs")
        out += blocks
    return np.concatenate(out) if out else np.zeros(0, "<u4")
