"""An adaptive context-mixing range coder for blocks of ids, many blocks in step.

Three predictions are mixed for each id, and all bits go through the range coder:

* order 2 proposes the id that last followed the two ids before, learnt within the
  block.  Its weight in the mixture is learnt within the block as well: the hit rate,
  by exponential decay, of proposals with the same record of hits and misses;
* order 1 has the distribution of the ids that follow the last one;
* order 0 has the distribution of all ids.  The chance that an id comes from it is the
  part of order 1's distribution that is left for ids not listed there.

Orders 0 and 1 are learnt from a whole segment and stored with it, as its prior: ids
by falling frequency, quantised counts, and for each id the followers seen PAIRS times
or more.  Each block starts anew from its segment's prior with an empty order 2 and
the weights of START, so that it can be decoded alone.

numpy works on one position of all blocks at a time, so the cost of a step is shared
by hundreds of blocks.  All decisions are made in whole numbers, or in divisions
whose rounding can't change the floor.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block; slots of a block's order-2 table.
BLOCK, SLOTS = 2048, 1024
#: Least count of a listed follower, and most followers listed for one id (the most frequent ones).
PAIRS, MOST_NEXT = 4, 4096
#: Bits of the mixture's and order 0's totals; most bits of an id's total in order 1, and bits beyond those of its followers' number.
MIX, ZERO, ONE, FINE = 18, 16, 14, 5
#: Pairs of ranks below this are looked up in a square table.
DENSE = 1024
#: Largest weight of order 2 (what remains gives each follower a part), decay of a weight, and weights at the start by trust (1..7).
CAP, DECAY = (1 << MIX) * 15 // 16, 4
START = (np.array([0, 0.06, 0.35, 0.55, 0.7, 0.8, 0.87, 0.93]) * CAP).astype(np.int64)
_LOW = np.uint64((1 << 32) - 1)
_16, _32, _MIX, _ZERO = np.uint64(16), np.uint64(32), np.uint64(MIX), np.uint64(ZERO)
_LEAST = np.uint64(1 << 32)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Codes of counts from 1 on: two bits behind the leading one, rounded down."""
    c = counts.astype(np.int64) * 4
    e = np.zeros(len(c), dtype=np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        e += s * (c >> e + 2 >= 1 << s)
    return (4 * e + (c >> e & 3)).astype(np.uint8)


def _values(codes: np.ndarray) -> np.ndarray:
    q = codes.astype(np.int64)
    return (4 + (q & 3)) << (q >> 2)


def _parts(values: np.ndarray, owner: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each value in its owner's total, one at least each; owners' values lie together, the last one takes the rest."""
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    upto = np.concatenate([[0], np.cumsum(values)])
    sums = upto[first + count] - upto[first]
    size = 1 + values * ((total - count)[owner]) // np.maximum(1, sums)[owner]
    ends = np.cumsum(size)
    start = ends - size
    start -= start[first[owner]]
    last = (first + count - 1)[count > 0]
    size[last] = total[count > 0] - start[last]
    return start, size


class Prior:
    """A segment's order 0 and order 1.

    ids by falling frequency (their places are the ranks that everything else uses) and the
    codes of their counts; by rank the number of listed followers; the followers; the codes of
    their counts; and by rank that has any the code of the rest's count.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, degree: np.ndarray, followers: np.ndarray, weights: np.ndarray, rest: np.ndarray) -> None:
        self.ids, self.counts, self.degree, self.followers, self.weights, self.rest = ids, counts, degree, followers, weights, rest
        n = len(ids)
        self.start0, self.size0 = _parts(_values(counts), np.zeros(n, np.int64), np.array([n]), np.array([1 << ZERO])) if n else (np.zeros(0, np.int64),) * 2
        # each rank's followers, and behind them what is left for order 0; rank n stands before a block's first id
        entries = np.append(degree, 0) + 1
        end = np.cumsum(entries)
        self.owner = np.repeat(np.arange(n + 1), entries)
        self.symbol = np.full(len(self.owner), -1, dtype=np.int64)
        value = np.ones(len(self.owner), dtype=np.int64)
        listed = np.ones(len(self.owner), dtype=bool)
        listed[end - 1] = False
        self.symbol[listed], value[listed] = followers, _values(weights)
        value[(end - 1)[:-1][degree > 0]] = _values(rest)
        self.bits = np.where(entries > 1, np.minimum(ONE, FINE + np.ceil(np.log2(entries)).astype(np.int64)), 0)
        self.start1, self.size1 = _parts(value, self.owner, entries, 1 << self.bits)
        self.left = end - 1  # by rank the entry of what is left
        self.pairs = self.owner[listed] << 16 | self.symbol[listed]
        self.entry = np.flatnonzero(listed)

    @classmethod
    def of(cls, flat: np.ndarray, breaks: int) -> tuple[Prior, np.ndarray]:
        """The prior of ids whose blocks are breaks long, and the ranks of the ids."""
        counts = np.bincount(flat, minlength=1)
        order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        rank = np.zeros(len(counts), dtype=np.int64)
        rank[order] = np.arange(len(order))
        r = rank[flat]
        inner = np.ones(max(0, len(r) - 1), dtype=bool)
        inner[breaks - 1 :: breaks] = False
        keys = np.sort((r[:-1] << 16 | r[1:])[inner])
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        all_ = np.bincount(keys >> 16, weights=n, minlength=len(order)).astype(np.int64)
        keep = n >= PAIRS
        keys, n = keys[keep], n[keep]
        if len(keys) and np.bincount(keys >> 16).max() > MOST_NEXT:
            by_count = np.lexsort((keys, -n, keys >> 16))
            place = np.arange(len(keys)) - np.searchsorted(keys[by_count] >> 16, keys[by_count] >> 16)
            stay = np.sort(by_count[place < MOST_NEXT])
            keys, n = keys[stay], n[stay]
        degree = np.bincount(keys >> 16, minlength=len(order)).astype(np.int64)
        listed = np.bincount(keys >> 16, weights=n, minlength=len(order)).astype(np.int64)
        rest = quantised(np.maximum(1, all_ - listed)[degree > 0])
        return cls(order.astype(np.int64), quantised(counts[order]), degree, keys & 0xFFFF, quantised(n), rest), r

    def dump(self) -> bytes:
        """The tables, before compression."""
        gaps = np.diff(self.pairs, prepend=0) & 0xFFFF  # within an id the followers ascend; a new id's first gap wraps
        wide = gaps.astype("<u2").view(np.uint8).reshape(-1, 2)
        head = np.array([len(self.ids), len(self.followers)], dtype="<u4").tobytes()
        return b"".join([head, self.ids.astype("<u2").tobytes(), self.counts.tobytes(), self.degree.astype("<u2").tobytes(), wide[:, 0].tobytes(), wide[:, 1].tobytes(), self.weights.tobytes(), self.rest.tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> Prior:
        n, m = np.frombuffer(raw, "<u4", 2).tolist()
        at = 8

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, count, at)
            at += x.nbytes
            return x

        ids, counts, degree = take("<u2", n).astype(np.int64), take("u1", n), take("<u2", n).astype(np.int64)
        gaps = take("u1", m).astype(np.int64) | take("u1", m).astype(np.int64) << 8
        followers = np.cumsum(gaps) & 0xFFFF
        return cls(ids, counts, degree, followers, take("u1", m), take("u1", int(np.count_nonzero(degree))))

    def coded(self, ranks: np.ndarray, breaks: int) -> np.ndarray:
        """By id the entry of order 1 that codes it: a follower's, or what is left for order 0."""
        before = np.empty(len(ranks), dtype=np.int64)
        before[1:] = ranks[:-1]
        before[::breaks] = len(self.ids)
        out = self.left[before]
        if len(self.pairs):
            table = np.full(DENSE * DENSE, -1, dtype=np.int32)
            first, follower = self.pairs >> 16, self.pairs & 0xFFFF
            inside = (first < DENSE) & (follower < DENSE)
            table[first[inside] * DENSE + follower[inside]] = self.entry[inside]
            inside = (before < DENSE) & (ranks < DENSE)
            got = table.take(np.where(inside, before * DENSE + ranks, 0))
            inside &= got >= 0
            out = np.where(inside, got, out)
            rare = np.flatnonzero((before >= DENSE) | (ranks >= DENSE))
            key = before[rare] << 16 | ranks[rare]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            found = self.pairs[at] == key
            out[rare[found]] = self.entry[at[found]]
        return out


class Orders:
    """Several segments' priors side by side; a lane's ranks, contexts and entries are shifted by its segment's offsets."""

    def __init__(self, priors: list[Prior]) -> None:
        sizes = np.array([len(p.ids) for p in priors], dtype=np.int64)
        self.rank0 = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.entry0 = np.concatenate([[0], np.cumsum([len(p.owner) for p in priors])])[:-1]
        self.first = self.rank0 + sizes  # context before a block's first id
        self.start1 = np.concatenate([p.start1 for p in priors])
        self.size1 = np.concatenate([p.size1 for p in priors])
        self.symbol = np.concatenate([np.where(p.symbol < 0, -1, p.symbol + r) for p, r in zip(priors, self.rank0)])
        self.bits = np.concatenate([p.bits for p in priors])
        self.hash = np.concatenate([np.arange(n + 1) for n in sizes.tolist()]) * 40503 >> 4 & SLOTS - 1  # by own rank: the same in any company
        none = np.zeros(1, dtype=np.int64)
        self.start0 = np.concatenate([x for p in priors for x in (p.start0, none)])
        self.size0 = np.concatenate([x for p in priors for x in (p.size0, none)])

    def lookups(self, priors: list[Prior]) -> None:
        """For reading: by segment and part of order 0's total the rank, and by context and part of its total the entry."""
        self.place1 = np.concatenate([[0], np.cumsum(1 << self.bits)[:-1]])
        self.by_part1 = np.repeat(np.arange(len(self.size1), dtype=np.int32), self.size1)
        self.by_part0 = np.concatenate([np.repeat(np.arange(len(p.ids)) + r, p.size0) if len(p.ids) else np.zeros(1 << ZERO, np.int64) for p, r in zip(priors, self.rank0)]).astype(np.int32)


class Order2:
    """Order 2 and its weights for n lanes; a step works on the first m of them."""

    def __init__(self, n: int, first: np.ndarray, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.n, self.home = n, np.arange(n, dtype=np.int64) * SLOTS
        self.lane = np.arange(n, dtype=np.int64)
        self.slots = np.zeros(n * SLOTS, dtype=np.int32)
        self.weights = np.repeat(START, n)
        self.last, self.hash = first.copy(), hashes[first]

    def predict(self, m: int) -> None:
        self.m = m
        hashed = self.hashes.take(self.last[:m])
        self.at = (hashed ^ self.hash[:m] >> 1) + self.home[:m]
        self.hash[:m] = hashed
        self.entry = self.slots.take(self.at)
        self.proposal, self.trust = self.entry >> 3, self.entry & 7
        self.w_at = self.trust * self.n + self.lane[:m]
        self.w = self.weights.take(self.w_at)
        self.rest = (1 << MIX) - self.w

    def update(self, rank: np.ndarray, right: np.ndarray) -> None:
        """rank came; right says where the proposal was that."""
        m = self.m
        right = right & (self.trust > 0)
        # one more or less trust within 1..7; a proposal of trust 1 that was wrong, or none, gives way to the new id
        changed = self.entry - 1
        changed += (right & (self.trust < 7)).view(np.int8)
        changed += right.view(np.int8)
        self.slots[self.at] = np.where(right | (self.trust > 1), changed, rank << 3 | 1)
        self.weights[self.w_at] = self.w + (right * CAP - self.w >> DECAY)
        self.last[:m] = rank


class Writer:
    """Range coders of n lanes.  Carries stay in the words, which have room for them, until finish()."""

    def __init__(self, n: int, width: int) -> None:
        self.width = width
        self.words = np.zeros(n * width, dtype=np.uint32)
        self.at = np.arange(n, dtype=np.int64) * width
        self.first = self.at.copy()
        self.low, self.range = np.zeros(n, dtype=np.uint64), np.full(n, (1 << 48) - 1, dtype=np.uint64)

    def step(self, lanes: slice | np.ndarray, start: np.ndarray, size: np.ndarray, bits: np.uint64) -> None:
        r = self.range[lanes] >> bits
        self.low[lanes] += start.view(np.uint64) * r
        r *= size.view(np.uint64)
        self.range[lanes] = r
        i = np.flatnonzero(r < _LEAST)
        if isinstance(lanes, np.ndarray):
            i = lanes[i]
        while len(i):
            low, at, r = self.low[i], self.at[i], self.range[i] << _16
            self.words[at] += (low >> _32).astype(np.uint32)
            self.low[i] = (low & _LOW) << _16
            self.range[i], self.at[i] = r, at + 1
            i = i[r < _LEAST]

    def finish(self) -> list[np.ndarray]:
        """Each lane's 16-bit words."""
        for _ in range(3):
            self.words[self.at] += (self.low >> _32).astype(np.uint32)
            self.low = (self.low & _LOW) << _16
            self.at += 1
        while len(i := np.flatnonzero(self.words > 0xFFFF)):
            self.words[i - 1] += self.words[i] >> np.uint32(16)
            self.words[i] &= np.uint32(0xFFFF)
        return [self.words[a:b].astype("<u2") for a, b in zip(self.first.tolist(), self.at.tolist())]


class Reader:
    """Range decoders of n lanes."""

    def __init__(self, codes: list[bytes]) -> None:
        parts = [np.frombuffer(c, dtype="<u2") for c in codes]
        width = max(map(len, parts)) + 8
        words = np.zeros((len(parts), width), dtype=np.uint16)
        for k, p in enumerate(parts):
            words[k, : len(p)] = p
        self.words, self.at = words.reshape(-1), np.arange(len(parts), dtype=np.int64) * width
        self.last = self.at + width - 1
        self.range, self.code = np.full(len(parts), (1 << 48) - 1, dtype=np.uint64), np.zeros(len(parts), dtype=np.uint64)
        for _ in range(3):
            self.code = self.code << _16 | self.words[self.at]
            self.at += 1

    def target(self, lanes: slice | np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's code lies in its total, and the unit; the division is exact as all is below 2^53."""
        r = self.range[lanes] >> bits
        return np.minimum((self.code[lanes] / r).astype(np.int64), (1 << int(bits)) - 1), r

    def step(self, lanes: slice | np.ndarray, start: np.ndarray, size: np.ndarray, r: np.ndarray) -> None:
        self.code[lanes] -= start.view(np.uint64) * r
        r = r * size.view(np.uint64)
        self.range[lanes] = r
        i = np.flatnonzero(r < _LEAST)
        if isinstance(lanes, np.ndarray):
            i = lanes[i]
        while len(i):
            at, r = self.at[i], self.range[i] << _16
            self.code[i] = self.code[i] << _16 | self.words[at]
            # a damaged code may run on: it rests at the last word, and the checksum tells
            self.range[i], self.at[i] = r, np.minimum(at + 1, self.last[i])
            i = i[r < _LEAST]


def _active(lengths: np.ndarray) -> list[int]:
    """For each position the number of lanes that reach it (lengths fall)."""
    return (len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")).tolist()


def _lanes(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of segments with so many ids: segment, first id and length of each, and the order of falling length."""
    segment = np.repeat(np.arange(len(counts)), [-(-n // BLOCK) for n in counts])
    begin = np.concatenate([np.arange(0, n, BLOCK) for n in counts]) if counts else np.zeros(0, np.int64)
    length = np.minimum(BLOCK, np.array(counts, dtype=np.int64)[segment] - begin)
    return segment, begin, length, np.argsort(-length, kind="stable")


def encode(segments: list[np.ndarray]) -> list[tuple[bytes, list[bytes]]]:
    """Of each segment of ids (below 2^16) its prior's tables and the code of each of its blocks."""
    if not segments:
        return []
    made = [Prior.of(s, BLOCK) for s in segments]
    priors = [p for p, _ in made]
    orders = Orders(priors)
    segment, begin, length, order = _lanes([len(s) for s in segments])
    codes: list[bytes] = [b""] * len(order)
    if len(order):
        shape = (len(order), int(length.max()))
        ranks, entries = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=np.int32)
        coded = [p.coded(r, BLOCK) + e for (p, r), e in zip(made, orders.entry0)]
        for lane, k in enumerate(order.tolist()):
            s, a, n = segment[k], begin[k], length[k]
            ranks[lane, :n] = made[s][1][a : a + n] + orders.rank0[s]
            entries[lane, :n] = coded[s][a : a + n]
        ranks, entries = np.ascontiguousarray(ranks.T), np.ascontiguousarray(entries.T)
        two = Order2(len(order), orders.first[segment[order]], orders.hash)
        out = Writer(len(order), 3 * shape[1] + 8)
        for at, m in enumerate(_active(length[order])):
            x, e = ranks[at, :m], entries[at, :m]
            two.predict(m)
            right = two.proposal == x
            hit = right & (two.w > 0)
            a = orders.start1.take(e)
            bits = orders.bits.take(two.last[:m])
            b = two.w + ((a + orders.size1.take(e)) * two.rest >> bits)
            a = (a * two.rest >> bits) + two.w
            start = np.where(hit, 0, a)
            out.step(slice(m), start, np.where(hit, two.w, b - a), _MIX)
            low = np.flatnonzero((orders.symbol.take(e) < 0) & ~hit)
            if len(low):
                y = x[low]
                out.step(low, orders.start0.take(y), orders.size0.take(y), _ZERO)
            two.update(x, right)
        for words, k in zip(out.finish(), order.tolist()):
            codes[k] = words.tobytes()
    edges = np.searchsorted(segment, np.arange(len(segments) + 1)).tolist()
    return [(p.dump(), codes[a:b]) for p, a, b in zip(priors, edges, edges[1:])]


def decode(parts: list[tuple[bytes, list[bytes], int]]) -> list[np.ndarray]:
    """The ids of each segment, from its prior's tables, its blocks' codes and its number of ids."""
    if not parts:
        return []
    priors = [Prior.load(t) for t, _, _ in parts]
    orders = Orders(priors)
    orders.lookups(priors)
    segment, begin, length, order = _lanes([n for _, _, n in parts])
    out = [np.zeros(n, dtype=np.int64) for _, _, n in parts]
    if not len(order):
        return out
    codes = [c for _, cs, _ in parts for c in cs]
    own = segment[order]
    coder, two = Reader([codes[k] for k in order.tolist()]), Order2(len(order), orders.first[own], orders.hash)
    share0 = own << ZERO
    ranks = np.zeros((int(length.max()), len(order)), dtype=np.int32)
    for at, m in enumerate(_active(length[order])):
        two.predict(m)
        v, r = coder.target(slice(m), _MIX)
        hit = v < two.w
        bits = orders.bits.take(two.last[:m])
        u = (((np.maximum(v - two.w, 0) + 1 << bits) - 1) / two.rest).astype(np.int64)
        e = orders.by_part1.take(orders.place1.take(two.last[:m]) + u)
        a = orders.start1.take(e)
        b = two.w + ((a + orders.size1.take(e)) * two.rest >> bits)
        a = (a * two.rest >> bits) + two.w
        coder.step(slice(m), np.where(hit, 0, a), np.where(hit, two.w, b - a), r)
        x = np.where(hit, two.proposal, orders.symbol.take(e))
        low = np.flatnonzero(x < 0)
        if len(low):
            v, r = coder.target(low, _ZERO)
            y = orders.by_part0.take(share0[low] + v)
            coder.step(low, orders.start0.take(y), orders.size0.take(y), r)
            x[low] = y
        two.update(x, two.proposal == x)
        ranks[at, :m] = x
    lanes = np.ascontiguousarray(ranks.T)
    for lane, k in enumerate(order.tolist()):
        s, a, n = segment[k], begin[k], length[k]
        out[s][a : a + n] = priors[s].ids[lanes[lane, :n] - orders.rank0[s]]
    return out
