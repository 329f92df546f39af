"""An adaptive context-mixing range coder for token ids, in numpy over many lanes at once.

The ids are cut into blocks of up to ``BLOCK``; each starts from a fresh model,
carries a checksum and is decoded alone. A block is coded as parallel lanes
(runs of equal length, each with its own digits) that share the block's model:
step t codes id t of every lane, then the model learns all of them. So the
lanes cost no statistics, and a step is a few dozen array operations however
many lanes there are.

An id's probability is a mixture of distributions over all ids:

* order 0: frequencies of the block so far, with a share for ids not seen yet,
* order 1: an id that followed the last id,
* order 2: an id that followed the last two.

A context's slot keeps a second id, which takes the first one's place once it is the better guess.

Weights are learned: what the contexts' slots are worth is counted for every
pair of their states, as the ids come. The range coder works on the cumulative
sums of the mixture itself, so an id that several orders predict gets the sum
of its shares. Frequencies and weights are taken up at ever longer intervals,
slots after each step.

A block is: 4 bytes magic, number of ids, number of lanes, bytes of the alphabet
and crc32 of the ids as little-endian 32-bit integers (each little-endian 32
bits), the alphabet, the number of 16-bit digits of each lane (little-endian 16
bits), the lanes' digits (big-endian). The alphabet is the ascending list of the
block's different ids as steps, 255 meaning 255 and on; the model numbers ids by
their place in it. Ids must be below 65,536.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1 << 22
LANES = 4096
STEPS = 64
MAGIC = b"CWT2"
HEAD = struct.Struct("<IIII")
SLOTS = 1 << 18
STATES = 64
REFRESH = 80
CEILING = 1 << 12
COARSE = 7
# Their product stays below 2^31, so that shares are 32-bit integers.
_TOTAL, _WEIGHT = 1 << 21, (1 << 10) - 1
_MASS = np.uint64(_TOTAL * _WEIGHT)
_S4, _S16, _S48 = np.uint64(4), np.uint64(16), np.uint64(48)
_THIN = np.uint64(1 << 48)


def _slot_rules():
    """For (outcome, state): the state after it, whether the id becomes the first guess, whether the second.

    A state is the confidences (0 to 7) in a slot's two guesses; outcomes: the
    first guess was right, the second, neither.
    """
    after, lead, second = (np.zeros(3 * STATES, np.uint8) for _ in range(3))
    for state in range(STATES):
        a, b = divmod(state, 8)
        after[state] = min(a + 1, 7) * 8 + b
        up = min(b + 1, 7)
        after[STATES + state] = (up * 8 + max(a - 1, 0)) if up > a else (a * 8 + up)
        lead[STATES + state] = up > a
        if a == 0:
            after[2 * STATES + state], lead[2 * STATES + state] = 8, True
        elif b == 0:
            after[2 * STATES + state], second[2 * STATES + state] = (max(a - 1, 1) if a > 2 else a) * 8 + 1, True
        else:
            after[2 * STATES + state] = (a - (a > 3)) * 8 + b - 1
    return after, lead.astype(np.int32), second.astype(np.int32)


_AFTER, _LEAD, _SECOND = _slot_rules()
_AFTER = _AFTER.astype(np.int64) << 32
# As masks: all bits set where the rule holds; no rule is in both.
_LEAD, _SECOND = -_LEAD, -_SECOND
_MIX = np.array([0x2545F491, 0x1E3779B1], np.int32)
# By which guesses were right (1: order 1's, 2: order 2's): the more specific has the credit, none order 0.
_CREDIT = np.array([2, 0, 1, 1]) * STATES**2
_OUTCOME = np.array([2, 0, 1, 0]) * STATES


class _Model:
    """The mixture of a block, driven alike by coder and decoder."""

    def __init__(self, lanes: int, ids: int):
        self.ids = ids
        # Slots of order 1, then of order 2: first guess, second guess (16 bits each), state.
        self.slots = np.zeros((1 << 16) + SLOTS, "<i8")
        self.seen = np.zeros(ids, np.int64)
        # Before anything is known a confident guess is worth a little more than an unsure one.
        a, b = np.divmod(np.arange(STATES), 8)
        two, one = np.divmod(np.arange(STATES**2), STATES)
        self.worth = np.stack([a[one], a[two], np.full(STATES**2, 4)])
        self.one, self.two = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.at = np.zeros((2, lanes), np.int64)
        self.kept: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        self.waited, self.total = 0, 0
        self.refresh()

    def refresh(self) -> None:
        """Take up what was learned since the last time."""
        if self.kept:
            new = np.concatenate(self.kept)
            self.seen += np.bincount(new, minlength=self.ids)
            self.total += len(new)
            self.worth += np.bincount(np.concatenate(self.kinds), minlength=self.worth.size).reshape(self.worth.shape)
            full = self.worth.sum(axis=0) > CEILING
            self.worth[:, full] = (self.worth[:, full] + 1) >> 1
            self.kept, self.kinds = [], []
        # The share of ids not seen is that of new ones so far; every id gets at least 1.
        distinct = int(np.count_nonzero(self.seen))
        spread = (_TOTAL - self.ids) * distinct // max(1, self.total + distinct) if self.total else _TOTAL - self.ids
        held = _TOTAL - self.ids - spread
        sums = np.zeros(self.ids + 1, np.int64)
        np.cumsum(self.seen, out=sums[1:])
        at = np.arange(self.ids + 1, dtype=np.int64)
        self.sums = (at + at * spread // self.ids + sums * held // max(1, self.total)).astype(np.int32)
        # For every COARSE-th place the id that holds it: where the search for a place begins.
        first = self.sums[:-1] + ((1 << COARSE) - 1) >> COARSE
        self.coarse = np.cumsum(np.bincount(first, minlength=(_TOTAL >> COARSE) + 1)) - 1
        share = self.worth[:2] * (_WEIGHT - 15) // self.worth.sum(axis=0)
        self.share = np.concatenate([share * _TOTAL, _WEIGHT - share.sum(axis=0, keepdims=True)]).astype(np.int32)
        self.waited = 0

    def narrow(self, n: int) -> None:
        """Go on with the first n lanes."""
        self.one, self.two, self.at = self.one[:n], self.two[:n], np.ascontiguousarray(self.at[:, :n])

    def predict(self) -> None:
        """Guesses of the contexts (first ones of orders 1 and 2, second ones), the weights of the first two, and order 0's."""
        self.at[0] = self.one
        self.at[1] = (((self.one * _MIX[0] + self.two * _MIX[1]).view(np.uint32) >> np.uint32(14)) & np.uint32(SLOTS - 1)) + np.uint32(1 << 16)
        slot = self.slots.take(self.at)
        parts = slot.view("<u2").reshape(2, -1, 4)
        self.guess = np.empty((4, slot.shape[1]), np.int32)
        self.guess[:2], self.guess[2:] = parts[..., 0], parts[..., 1]
        self.before = slot >> 32
        self.pair = self.before[1] * STATES + self.before[0]
        share = self.share.take(self.pair, axis=1)
        self.weight, self.rest = share[:2], share[2]

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of ids in the mixture."""
        apart = self.guess - ids
        self.hit = apart == 0
        below = apart[:2] >> 31 & self.weight
        same = -self.hit[:2].astype(np.int32) & self.weight
        low = self.sums.take(ids)
        start = self.rest * low + (below[0] + below[1])
        width = self.rest * (self.sums.take(ids + 1) - low) + (same[0] + same[1])
        return start, width

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids in whose shares the values lie."""
        # The guesses in ascending order, each with its weight (below 2^31) behind it.
        a, b = self.guess[:2].astype(np.int64) << 32 | self.weight
        ordered = np.stack([np.minimum(a, b), np.maximum(a, b)])
        guess, weight = (ordered >> 32).astype(np.int32), ordered.astype(np.int32)
        ends = self.rest * self.sums.take(guess + 1)
        ends[0] += weight[0]
        ends[1] += weight[0] + weight[1]
        over = -(value >= ends).astype(np.int32)
        passed = weight & over
        passed = passed[0] + passed[1]
        next_guess = guess[0] ^ (guess[0] ^ guess[1]) & over[0]
        next_guess ^= (next_guess ^ np.int32(self.ids)) & over[1]
        # What lies at or behind the start of the next guess is that guess; the rest is order 0's alone.
        left = (value - passed) // self.rest
        ids = next_guess
        other = np.flatnonzero(left < self.sums.take(next_guess))
        left = left.take(other)
        found = self.coarse.take(left >> COARSE)
        far = np.flatnonzero(self.sums.take(found + 1) <= left)
        for _ in range(2):
            found[far] += 1
            far = far[self.sums.take(found.take(far) + 1) <= left.take(far)]
        found[far] = np.searchsorted(self.sums, left.take(far), side="right") - 1
        ids[other] = found
        return ids

    def learn(self, ids: np.ndarray) -> None:
        hit = self.hit.view(np.uint8)
        self.kept.append(ids)
        self.kinds.append(_CREDIT.take(hit[0] | hit[1] << 1) + self.pair)
        rule = _OUTCOME.take(hit[:2] | hit[2:] << 1) + self.before
        first, other, lead = self.guess[:2], self.guess[2:], _LEAD.take(rule)
        other = other ^ (other ^ first) & lead ^ (other ^ ids) & _SECOND.take(rule)
        first = first ^ (first ^ ids) & lead
        self.slots[self.at.reshape(-1)] = (_AFTER.take(rule) | other.astype(np.int64) << 16 | first).reshape(-1)
        self.two, self.one = self.one, ids
        self.waited += len(ids)
        if self.waited * 5 > self.total or len(self.kept) >= REFRESH:
            self.refresh()


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = max(1, min(LANES, n // STEPS))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def encode(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The blocks of ``ids``."""
    ids = np.asarray(ids)
    if len(ids) == 0:
        return []
    if int(ids.max()) >= 1 << 16 or int(ids.min()) < 0:
        raise ValueError("ids must lie in 0 to 65,535")
    return [_encode(ids[i : i + block]) for i in range(0, len(ids), block)]


def _encode(ids: np.ndarray) -> bytes:
    n, alphabet = len(ids), np.flatnonzero(np.bincount(ids))
    lanes, steps = _shape(n)
    number = np.zeros(1 << 16, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    last = n - (lanes - 1) * steps
    padded = np.zeros(lanes * steps, np.int32)
    padded[:n] = number[ids]
    columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(lanes, len(alphabet))
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    # Digit k of every lane side by side, as a step writes much the same k in all.
    digits = np.zeros((3 * steps + 2, lanes), np.int32)
    flat, used = digits.reshape(-1), np.arange(lanes)
    for t in range(steps):
        if t == last and last < steps:
            model.narrow(lanes - 1)
        m = len(model.one)
        now = columns[t, :m]
        model.predict()
        start, width = model.place(now)
        part = size[:m] // _MASS
        bottom = low[:m] + part * start.astype(np.uint64)
        over = np.flatnonzero(bottom < low[:m])
        if len(over):
            flat[used[over] - lanes] += 1
        span = part * width.astype(np.uint64)
        thin = span < _THIN
        while thin.any():
            which = np.flatnonzero(thin)
            at = used.take(which)
            flat[at] = bottom.take(which) >> _S48
            used[which] = at + lanes
            shift = thin.astype(np.uint64) << _S4
            bottom <<= shift
            span <<= shift
            thin = span < _THIN
        low[:m], size[:m] = bottom, span
        model.learn(now)
    # One more digit names a number inside the last range; what follows is read as zeros.
    bottom = low + (_THIN - np.uint64(1))
    over = np.flatnonzero(bottom < low)
    flat[used[over] - lanes] += 1
    flat[used] = bottom >> _S48
    used = used // lanes + 1
    digits = np.ascontiguousarray(digits[: int(used.max())].T)
    while True:
        over = digits >> 16
        if not over.any():
            break
        digits &= 0xFFFF
        digits[:, :-1] += over[:, 1:]
    body = digits[np.arange(digits.shape[1]) < used[:, None]].astype(">u2").tobytes()
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    far, near = np.divmod(np.diff(alphabet, prepend=0), 255)
    listed = np.full(int(far.sum()) + len(alphabet), 255, np.uint8)
    listed[np.cumsum(far + 1) - 1] = near
    return MAGIC + HEAD.pack(n, lanes, len(listed), crc) + listed.tobytes() + used.astype("<u2").tobytes() + body


def decode(data: bytes) -> np.ndarray:
    """The ids of concatenated blocks, each of which is checked."""
    out, at, number = [np.zeros(0, np.uint32)], 0, 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        if len(data) < at + 4 + HEAD.size:
            raise ValueError("the last block is cut short")
        n, lanes, listed, crc = HEAD.unpack_from(data, at + 4)
        at += 4 + HEAD.size
        if n < 1 or _shape(n)[0] != lanes or len(data) < at + listed + 2 * lanes:
            raise ValueError(f"block {number} has a broken head")
        steps = np.frombuffer(data, np.uint8, listed, at)
        alphabet = np.cumsum(steps, dtype=np.int64)[steps < 255]
        at += listed
        if not 0 < len(alphabet) <= n or alphabet[-1] >= 1 << 16:
            raise ValueError(f"block {number} has a broken alphabet")
        used = np.frombuffer(data, "<u2", lanes, at).astype(np.int64)
        at += 2 * lanes
        if len(data) < at + 2 * int(used.sum()):
            raise ValueError("the last block is cut short")
        ids = alphabet[_decode(np.frombuffer(data, ">u2", int(used.sum()), at), used, n, len(alphabet))].astype("<u4")
        at += 2 * int(used.sum())
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {number} fails its checksum")
        out.append(ids)
        number += 1
    return np.concatenate(out)


def _decode(body: np.ndarray, lengths: np.ndarray, n: int, ids: int) -> np.ndarray:
    lanes, steps = _shape(n)
    last = n - (lanes - 1) * steps
    # Zeros stand behind each lane. A broken block may ask for more, and fails its checksum.
    digits = np.zeros((lanes, int(lengths.max()) + 4), np.uint16)
    digits[np.arange(digits.shape[1]) < lengths[:, None]] = body
    digits = np.ascontiguousarray(digits.T)
    model = _Model(lanes, ids)
    code = np.zeros(lanes, np.uint64)
    for i in range(4):
        code = code << _S16 | digits[i]
    size, used = np.full(lanes, 2**64 - 1, np.uint64), np.arange(lanes) + 4 * lanes
    flat = digits.reshape(-1)
    most = _MASS - np.uint64(1)
    out = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        if t == last and last < steps:
            model.narrow(lanes - 1)
        m = len(model.one)
        model.predict()
        part = size[:m] // _MASS
        now = model.find(np.minimum(code[:m] // part, most).astype(np.int32))
        start, width = model.place(now)
        left, span = code[:m] - part * start.astype(np.uint64), part * width.astype(np.uint64)
        thin = span < _THIN
        while thin.any():
            which = np.flatnonzero(thin)
            at = used.take(which)
            used[which] = at + lanes
            shift = thin.astype(np.uint64) << _S4
            left <<= shift
            span <<= shift
            left[which] |= flat.take(at, mode="clip")
            thin = span < _THIN
        code[:m], size[:m] = left, span
        model.learn(now)
        out[t, :m] = now
    return np.ascontiguousarray(out.T).reshape(-1)[:n]
