"""Adaptive context-mixing range coder for ids, in independently reset, checksummed blocks.

Three models predict the next id: what followed the last two ids before (order 2), what followed the last one (order 1), and a table of
ids that the other two did not foresee (order 0). A range coder tells which of them is right, or that none is. The chances of these four
outcomes are mixed from two contexts, the last outcome and the last two, by how often each has been seen in the block so far; every
``CHUNK`` ids the mixture follows the counts. A place in the order-0 table and an id that nothing foresees are equiprobable, so
their bits are stored plainly beside the coder's words.

A block starts from the same state as every other, so blocks code and decode in any order; numpy runs many blocks in step. Outcomes depend on
outcomes alone, so a block's are decoded first; the ids follow in a second pass, which looks up only the models that were right.
Layout: magic, kind, steps, ids, bytes and the CRC-32 of the ids (little-endian), and the CRC-32 of these and all that follows; then for ids below 2^16, or for each half of wider ones,
the number of words, the 32-bit words, unforeseen ids (16 bits) and table places (8 bits). A block that would not shrink is kept raw.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"VTR4"
HEAD, CHECK = struct.Struct("<4sBIIII"), struct.Struct("<I")
RAW, CODED, WIDE = 0, 1, 2
#: Ids between two updates of the mixture.
CHUNK = 64
#: Blocks that are run in step at most.
LANES = 4096
_U = np.uint64
_TABLE1, _TABLE2, _TABLE0 = 8, 8, 8
#: Chances by the last outcome before anything is counted, and the ids that they and the shorter context count for.
_CHANCE = np.array([[0.55, 0.1, 0.2, 0.15], [0.4, 0.15, 0.25, 0.2], [0.1, 0.1, 0.6, 0.2], [0.1, 0.1, 0.5, 0.3]], np.float32)
_PRIOR, _SHORT, _KEEP = np.float32(8), np.float32(6), np.float32(0.96)
_HASH1, _HASH2 = np.uint32(2654435761), np.uint32(40503)
_LOW32 = _U((1 << 32) - 1)


class _Mixture:
    """Counts of the outcomes of n lanes by the last two outcomes, and the chances that follow. Arrays have the lane last, so that lanes in a like state lie together."""

    def __init__(self, n: int):
        self.n, self.counts = n, np.zeros((4, 4, 4, n), np.float32)  # last but one, last, outcome

    def shares(self) -> np.ndarray:
        """By both last outcomes, lane and outcome: where its part of 4096 begins, and its width in the upper half."""
        short = self.counts[0] + self.counts[1] + self.counts[2] + self.counts[3] + (_CHANCE * _PRIOR)[:, :, None]
        short *= _SHORT / (short[:, 0] + short[:, 1] + short[:, 2] + short[:, 3])[:, None]
        mixed = self.counts + short
        scale = np.float32(4092) / (mixed[:, :, 0] + mixed[:, :, 1] + mixed[:, :, 2] + mixed[:, :, 3])
        out, begin = np.empty((16, self.n, 4), np.int32), np.zeros((16, self.n), np.int32)
        for k in range(3):
            width = (mixed[:, :, k] * scale).astype(np.int32).reshape(16, self.n) + 1
            out[:, :, k] = begin | width << 16
            begin += width
        out[:, :, 3] = begin | (4096 - begin) << 16
        return out

    def learn(self, states: np.ndarray, outcomes: np.ndarray) -> None:
        """``states``: state * n + lane of a chunk (steps x lanes)."""
        seen = np.bincount((states << 2 | outcomes).ravel(), minlength=64 * self.n).reshape(4, 4, self.n, 4)
        self.counts *= _KEEP
        self.counts += seen.transpose(0, 1, 3, 2)


def _slots(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a lane's order-1 and order-2 tables after ids with these hashes."""
    return h >> np.uint32(32 - _TABLE1), h + before * _HASH2 >> np.uint32(32 - _TABLE2)


def _hashed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) * _HASH1


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order-1, order-2 and order-0 tables of n lanes, a lane's side by side, which spares misses of the cache; and where each begins."""
    ends = np.cumsum([0, 1 << _TABLE1, 1 << _TABLE2, 1 << _TABLE0])
    return np.zeros(n * ends[3], np.uint16), *(np.arange(n) * ends[3] + k for k in ends[:3])


def _outcomes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids: lanes x steps -> outcomes (0: order 2, 1: order 1, 2: order 0, 3: none), and the ids' places in the order-0 table; both lanes x steps."""
    n, steps = ids.shape
    tables, at1, at2, at0 = _tables(n)
    out, places = np.empty((n, steps), np.uint8), np.empty((n, steps), np.uint8)
    h1 = h2 = np.zeros((1, n), np.uint32)
    for begin in range(0, steps, CHUNK):
        x = np.ascontiguousarray(ids[:, begin : begin + CHUNK].T)
        c, h = len(x), _hashed(x)
        h = np.concatenate([h2, h1, h])
        h2, h1 = h[c : c + 1], h[c + 1 :]
        i1, i2 = _slots(h[1:-1], h[:-2])
        i1, i2, place = at1 + i1, at2 + i2, h[2:] >> np.uint32(32 - _TABLE0)
        i0, which = at0 + place, np.empty(x.shape, np.uint8)
        for t in range(c):
            own, a, b = x[t], i1[t], i2[t]
            miss2, miss1 = tables.take(b) != own, tables.take(a) != own
            tables[a] = tables[b] = own
            which[t] = miss2
            rare = (miss1 & miss2).nonzero()[0]
            own, a = own.take(rare), i0[t].take(rare)
            which[t][rare] = 3 - (tables.take(a) == own)
            tables[a] = own
        out[:, begin : begin + c], places[:, begin : begin + c] = which.T, place.T
    return out, places


def _encode_lanes(ids: np.ndarray) -> list[bytes]:
    """ids: lanes x steps, 16 bits -> the lanes' payloads."""
    n, steps = ids.shape
    outcomes, places = _outcomes(ids)
    mixture, lane = _Mixture(n), np.arange(n)
    low, wide = np.zeros(n, _U), np.full(n, 2**64 - 1, _U)
    # a word of a lane is at word * n + lane: lanes write at about the same time, so that stays in one place
    words, at = np.zeros((steps // 2 + 4) * n, np.uint32), lane.copy()
    state = np.full((2, n), 3, np.int64)
    for begin in range(0, steps, CHUNK):
        which = np.concatenate([state, outcomes[:, begin : begin + CHUNK].T])
        c, state = len(which) - 2, which[-2:]
        states = (which[:-2] << 2 | which[1:-1]) * n + lane
        share = mixture.shares().ravel().take(states << 2 | which[2:])
        mixture.learn(states, which[2:])
        first, width = (share & 0xFFFF).astype(_U), (share >> 16).astype(_U)
        for t in range(c):
            r = wide >> _U(12)
            more = r * first[t]
            low += more
            wide = r * width[t]
            carried = (low < more).nonzero()[0]
            back = at.take(carried)
            while len(back):
                back -= n
                words[back] += np.uint32(1)
                back = back.compress(words.take(back) == 0)
            if t & 1 or t == c - 1:  # two steps take 24 bits at most
                done = (wide < _U(1 << 32)).nonzero()[0]
                ready, to = low.take(done), at.take(done)
                words[to], at[done] = ready >> _U(32), to + n
                low[done], wide[done] = ready << _U(32), wide.take(done) << _U(32)
    # one word more: the range holds a number whose lower half is 0, which needs no word
    more = low + _LOW32
    back = at.compress(more < low)
    while len(back):
        back -= n
        words[back] += np.uint32(1)
        back = back.compress(words.take(back) == 0)
    words[at] = more >> _U(32)
    at += n
    by_lane, rows = np.ascontiguousarray(words.reshape(-1, n).T).astype("<u4"), (at // n).tolist()
    fresh, found = (np.flatnonzero(outcomes == k) for k in (3, 2))
    after3, after2 = (np.searchsorted(x, np.arange(1, n + 1) * steps).tolist() for x in (fresh, found))
    fresh, found = ids.ravel().take(fresh).astype("<u2"), places.ravel().take(found)
    out, a, b = [], 0, 0
    for k in range(n):
        out.append(struct.pack("<I", rows[k]) + by_lane[k, : rows[k]].tobytes() + fresh[a : after3[k]].tobytes() + found[b : after2[k]].tobytes())
        a, b = after3[k], after2[k]
    return out


def _decode_outcomes(words: list[np.ndarray], steps: int) -> np.ndarray:
    """The lanes' words -> outcomes, lanes x steps."""
    n, most = len(words), max(map(len, words)) + 1  # with the word of zeros at the end
    by_lane = np.zeros((n, most), np.uint32)
    for k, own in enumerate(words):
        by_lane[k, : len(own)] = own
    flat, lane = np.ascontiguousarray(by_lane.T).ravel(), np.arange(n)
    gap, wide, at = flat[:n].astype(_U) << _U(32) | flat[n : 2 * n], np.full(n, 2**64 - 1, _U), lane + 2 * n
    mixture, out = _Mixture(n), np.empty((n, steps), np.uint8)
    ones = np.int64(1 | 1 << 16 | 1 << 32)
    high = np.int64(ones << 15)
    state, states, which = np.full(n, 15), np.empty((CHUNK, n), np.int64), np.empty((CHUNK, n), np.int64)
    for begin in range(0, steps, CHUNK):
        c, shares = min(CHUNK, steps - begin), mixture.shares()
        first = (shares & 0xFFFF).astype(np.int64)
        # a share is at or above a begin where this plus the share has the begin's high bit
        bounds = (high - (first[:, :, 1] | first[:, :, 2] << 16 | first[:, :, 3] << 32)).ravel()
        shares = shares.ravel()
        for t in range(c):
            where = np.add(state * n, lane, out=states[t])
            r = wide >> _U(12)
            found = (gap // r).view(np.int64) * ones + bounds.take(where) & high
            found = np.bitwise_and(found * ones >> 47, 3, out=which[t])
            share = shares.take(where << 2 | found)
            gap -= r * (share & 0xFFFF).astype(_U)
            wide = r * (share >> 16).astype(_U)
            state = (state << 2 | found) & 15
            if t & 1 or t == c - 1:
                done = (wide < _U(1 << 32)).nonzero()[0]
                to = at.take(done)
                gap[done], wide[done], at[done] = gap.take(done) << _U(32) | flat.take(to, mode="clip"), wide.take(done) << _U(32), to + n
        mixture.learn(states[:c], which[:c])
        out[:, begin : begin + c] = which[:c].T
    return out


def _decode_lanes(payloads: list[bytes], steps: int) -> np.ndarray:
    """The lanes' payloads -> ids, lanes x steps."""
    n, words = len(payloads), []
    for p in payloads:
        size = struct.unpack_from("<I", p)[0] if len(p) >= 4 else -1
        if size < 1 or 4 + 4 * size > len(p):
            raise ValueError("a block does not hold its words")
        words.append(np.frombuffer(p, "<u4", size, 4))
    outcomes = _decode_outcomes(words, steps)
    unforeseen, placed = outcomes == 3, outcomes == 2
    n3, n2 = unforeseen.sum(axis=1).tolist(), placed.sum(axis=1).tolist()
    if any(len(p) != 4 + 4 * len(w) + 2 * a + b for p, w, a, b in zip(payloads, words, n3, n2)):
        raise ValueError("a block does not hold what its outcomes need")
    plain = np.zeros((n, steps), np.uint16)
    plain[unforeseen] = np.frombuffer(b"".join(p[4 + 4 * len(w) : 4 + 4 * len(w) + 2 * a] for p, w, a in zip(payloads, words, n3)), "<u2")
    plain[placed] = np.frombuffer(b"".join(p[4 + 4 * len(w) + 2 * a :] for p, w, a in zip(payloads, words, n3)), np.uint8)

    tables, at1, at2, at0 = _tables(n)
    h, before, out = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.empty((n, steps), np.uint16)
    for begin in range(0, steps, CHUNK):
        x, which = np.ascontiguousarray(plain[:, begin : begin + CHUNK].T), np.ascontiguousarray(outcomes[:, begin : begin + CHUNK].T)
        c, chosen = len(x), []
        for k in range(4):
            at = np.flatnonzero(which.ravel() == k)
            cuts = np.searchsorted(at, np.arange(c + 1) * n)
            lanes = at - np.repeat(np.arange(c) * n, np.diff(cuts))
            if k == 2:
                places = at0.take(lanes) + x.ravel().take(at)
            elif k == 3:
                fresh = x.ravel().take(at)
                slots = at0.take(lanes) + (_hashed(fresh) >> np.uint32(32 - _TABLE0))
            chosen.append((lanes, cuts.tolist()))
        (l0, c0), (l1, c1), (l2, c2), (_, c3) = chosen
        for t in range(c):
            own = x[t]
            i1, i2 = _slots(h, before)
            i1, i2 = at1 + i1, at2 + i2
            hit = l0[c0[t] : c0[t + 1]]
            own[hit] = tables.take(i2.take(hit))
            hit = l1[c1[t] : c1[t + 1]]
            own[hit] = tables.take(i1.take(hit))
            own[l2[c2[t] : c2[t + 1]]] = tables.take(places[c2[t] : c2[t + 1]])
            tables[slots[c3[t] : c3[t + 1]]] = fresh[c3[t] : c3[t + 1]]
            tables[i1] = tables[i2] = own
            before, h = h, _hashed(own)
        out[:, begin : begin + c] = x.T
    return out


def encode(ids: np.ndarray, block: int) -> bytes:
    """Ids below 2^32 as a run of blocks of ``block`` ids; ``LANES`` of them are coded in step."""
    ids = np.ascontiguousarray(ids, "<u4")
    if not len(ids):
        return b""
    steps, n = min(block, len(ids)), -(-len(ids) // block)
    kind = WIDE if int(ids.max()) >> 16 else CODED
    padded = np.zeros(n * steps, "<u4")
    padded[: len(ids)] = ids
    grid, out = padded.reshape(n, steps), []
    for at in range(0, n, LANES):
        part = grid[at : at + LANES]
        coded = [_encode_lanes(h.astype(np.uint16)) for h in ((part & 0xFFFF, part >> 16) if kind == WIDE else (part,))]
        for k in range(len(part)):
            own = ids[(at + k) * block : (at + k + 1) * block]
            raw, mine = own.tobytes(), kind
            payload = coded[0][k] if kind == CODED else struct.pack("<I", len(coded[0][k])) + coded[0][k] + coded[1][k]
            if len(payload) >= (2 if kind == CODED else 4) * len(own):
                mine, payload = RAW, raw
            head = HEAD.pack(MAGIC, mine, steps, len(own), len(payload), zlib.crc32(raw))
            out += [head, CHECK.pack(zlib.crc32(payload, zlib.crc32(head))), payload]
    return b"".join(out)


def decode(data: bytes) -> np.ndarray:
    """The ids of a run of blocks; ValueError if a block isn't what was written."""
    blocks, at = [], 0
    while at < len(data):
        head, start = data[at : at + HEAD.size], at + HEAD.size + CHECK.size
        if len(data) < start:
            raise ValueError("a block's head is cut short")
        magic, kind, steps, n, size, crc = HEAD.unpack(head)
        if magic != MAGIC or len(data) < start + size or (kind == WIDE and size < 4):
            raise ValueError("not a block of this format, or cut short")
        if data[at + HEAD.size : start] != CHECK.pack(zlib.crc32(data[start : start + size], zlib.crc32(head))):
            raise ValueError("a block is damaged")
        blocks.append((kind, steps, n, crc, data[start : start + size]))
        at = start + size
    lanes: dict[int, list[tuple[int, int, bytes]]] = {}
    for k, (kind, steps, _, _, payload) in enumerate(blocks):
        if kind == CODED:
            lanes.setdefault(steps, []).append((k, 0, payload))
        elif kind == WIDE:
            cut = 4 + struct.unpack_from("<I", payload)[0]
            lanes.setdefault(steps, []).extend([(k, 0, payload[4:cut]), (k, 1, payload[cut:])])
    got: dict[tuple[int, int], np.ndarray] = {}
    for steps, every in lanes.items():
        for a in range(0, len(every), LANES):
            rows = every[a : a + LANES]
            ids = _decode_lanes([p for _, _, p in rows], steps)
            got |= {(k, half): ids[i] for i, (k, half, _) in enumerate(rows)}
    out = []
    for k, (kind, _, n, crc, payload) in enumerate(blocks):
        if kind == RAW:
            ids = np.frombuffer(payload, "<u4")
        else:
            ids = got[k, 0].astype(np.uint32)
            if kind == WIDE:
                ids |= got[k, 1].astype(np.uint32) << np.uint32(16)
        ids = np.ascontiguousarray(ids[:n], "<u4")
        if zlib.crc32(ids) != crc:
            raise ValueError(f"block {k} does not match its checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")
