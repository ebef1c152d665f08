"""Byte-level BPE over whole Arrow batches, by a hierarchical-bitmap rank queue.

All different pre-tokens of a batch lie side by side in one doubly linked list of symbols; no pair crosses the
border of a pre-token. Each merge rank has a bucket of list positions. A three-level bitmap over the ranks says by
find-first-set which bucket is next; its entries whose pair no longer stands there are stale and skipped, the
others are merged at once, and the pairs so made go into the buckets of their ranks. The cost of a merge does not
depend on the length of its pre-token, so one of 100,000 bytes is no special case.

Pre-tokens are cut by class runs (letters, digits, white space, others) found with array operations; the cut is that
of the pattern published with the vocabulary (`GPT-2 style`: optional space before a run, English contractions, a
run of white space leaving its last character to what follows).
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Code points handled at a time, and pre-tokens and bytes of them that are cached at most; none changes a result.
BLOCK, CACHE, CACHE_BYTES = 1 << 20, 400_000, 1 << 26


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    by_letter = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((by_letter.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE
    return out


def pretoken_starts(cp: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: booleans over code points. doc_start: booleans, true at each text's first."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    cls = classes()[cp]
    space, blank = cls == SPACE, cp == 0x20
    run = doc_start.copy()
    run[1:] |= cls[1:] != cls[:-1]
    # The last white space before other text in the same document stands alone, or leads the next run.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~doc_start[1:]
    lead = last & blank
    after_lead = np.zeros(n, bool)
    after_lead[1:] = lead[:-1]
    start = (run & ~after_lead) | last
    # Contractions: a lone apostrophe that no space leads, and its letters.
    at = np.flatnonzero((cp == 0x27) & run & ~after_lead)
    if len(at):
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        fresh = np.concatenate([doc_start, np.ones(3, bool)])
        a, b = padded[at + 1], padded[at + 2]
        one = np.isin(a, [ord(x) for x in "sdmt"]) & ~fresh[at + 1]
        two = np.zeros(len(at), bool)
        for x, y in ("ll", "ve", "re"):
            two |= (a == ord(x)) & (b == ord(y))
        two &= ~fresh[at + 1] & ~fresh[at + 2]
        for hit, length in ((one, 2), (two, 3)):
            where = at[hit]
            start[where + 1] = False
            end = where + length
            start[end[end < n]] = True
    return start


class Vocabulary:
    """Symbols of the 256 bytes, and for each pair that merges its rank and its result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        letters = {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.size = max(ids.values()) + 1
        key = self.left.astype(np.int64) * self.size + self.right
        self.order = np.argsort(key)
        self.keys = key[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels of 64-bit words."""

    def __init__(self, n: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low, self.mid, self.top = [0] * (n // 64 + 1), [0] * (n // 4096 + 1), 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for rank, i, j in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:]):
            self.buckets.setdefault(rank, []).append(positions[i:j])
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank that has a bucket, and the bucket; finds the first set bit from the top down."""
        if not self.top:
            return None
        first = lambda w: (w & -w).bit_length() - 1
        t = first(self.top)
        m = t << 6 | first(self.mid[t])
        rank = m << 6 | first(self.low[m])
        self.low[m] &= self.low[m] - 1
        if not self.low[m]:
            self.mid[t] &= self.mid[t] - 1
            if not self.mid[t]:
                self.top &= self.top - 1
        parts = self.buckets.pop(rank)
        return rank, (parts[0] if len(parts) == 1 else np.concatenate(parts))


def merge_all(data: np.ndarray, starts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """BPE of pre-tokens that lie end to end in ``data``: symbols that are left, and their positions."""
    n = len(data)
    sym = v.of_byte[data]
    nxt = np.arange(1, n + 1, dtype=np.int32)
    prv = np.arange(-1, n - 1, dtype=np.int32)
    nxt[-1] = -1
    nxt[starts[1:] - 1] = -1
    prv[starts] = -1
    queue = RankQueue(len(v.made))
    at = np.flatnonzero(nxt >= 0).astype(np.int32)
    ranks = v.ranks(sym[at], sym[at + 1])
    queue.push(ranks[ranks >= 0], at[ranks >= 0])
    while (entry := queue.pop()) is not None:
        rank, p = entry
        a, b, made = v.left[rank], v.right[rank], v.made[rank]
        q = nxt[p]
        fresh = (sym[p] == a) & (q >= 0) & (sym[q] == b)  # q of -1 reads the last symbol, and is masked
        p = np.unique(p[fresh])
        if not len(p):
            continue
        if a == b:  # in a chain of such pairs every other one merges, from the left
            linked = np.zeros(len(p), bool)
            linked[1:] = nxt[p[:-1]] == p[1:]
            i = np.arange(len(p))
            head = np.maximum.accumulate(np.where(linked, 0, i))
            p = p[(i - head) % 2 == 0]
        q = nxt[p]
        after = nxt[q]
        sym[p], sym[q] = made, -1
        nxt[p] = after
        has = after >= 0
        prv[after[has]] = p[has]
        before = prv[p]
        left, right = before[before >= 0], p[has]
        where = np.concatenate([left, right])
        if len(where):
            ranks = v.ranks(sym[where], sym[nxt[where]])
            keep = ranks >= 0
            queue.push(ranks[keep], where[keep])
    at = np.flatnonzero(sym >= 0)
    return sym[at], at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    offsets = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - offsets, lengths)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, other: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[at : at + length] equals b[other : other + length], for each row; compares eight bytes at a time."""
    words = [np.ndarray(max(len(x), 1), "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), strides=(1,)) for x in (a, b)]
    equal = np.ones(len(at), bool)
    rows, done = np.arange(len(at)), 0
    while len(rows):
        left = np.minimum(lengths[rows] - done, 8).astype(np.uint64)
        unlike = words[0][at[rows] + done] ^ words[1][other[rows] + done]
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left * np.uint64(8) & np.uint64(63))) - np.uint64(1))
        fine = (unlike & mask) == 0
        equal[rows[~fine]] = False
        done += 8
        rows = rows[fine & (lengths[rows] > done)]
    return equal


class Encoder:
    """Encodes batches of texts; keeps the results of pre-tokens it has seen.

    They are found by a 64-bit hash, and then compared byte for byte; different ones of one hash are told apart by a
    dictionary of their bytes.
    """

    def __init__(self, path: str):
        self.v = vocabulary(path)
        rng = np.random.default_rng(11)
        self.letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15 | 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.seen = np.zeros(0, np.uint8)  # the bytes of the pre-tokens by slot, end to end
        self.seen_at, self.seen_length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.clashing: dict[bytes, int] = {}

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(getattr(self, "up", ())) < n:
            size = max(n, BLOCK)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (self.base, self.inverse))
        return self.up, self.down

    def pretokens(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and keys of the pre-tokens of texts end to end, and each text's first pre-token. bounds: byte offsets of the texts, one more than texts."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        doc = np.zeros(len(cp) + 1, bool)
        doc[np.searchsorted(lead, bounds)] = True
        starts = lead[np.flatnonzero(pretoken_starts(cp, doc[:-1]))]
        up, down = self.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * up[: len(data)], out=total[1:])
        ends = np.append(starts[1:], len(data))
        key = (total[ends] - total[starts]) * down[starts]
        key ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        return starts, key, np.searchsorted(starts, bounds)

    def learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merges pre-tokens that are new and remembers their bytes and ids; their slots."""
        own, at = data[ragged(starts, lengths)], np.cumsum(lengths) - lengths
        ids, position = merge_all(own, at, self.v)
        first = np.searchsorted(position, at)
        slot = len(self.begin) + np.arange(len(starts))
        self.begin = np.concatenate([self.begin, len(self.ids) + first])
        self.count = np.concatenate([self.count, np.diff(np.append(first, len(position)))])
        self.ids = np.concatenate([self.ids, ids])
        self.seen_at = np.concatenate([self.seen_at, len(self.seen) + at])
        self.seen_length = np.concatenate([self.seen_length, lengths])
        self.seen = np.concatenate([self.seen, own])
        return slot

    def slots(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every pre-token, and each text's first pre-token."""
        if len(self.begin) > CACHE or len(self.seen) > CACHE_BYTES:
            self.forget()
        # Blocks of whole texts bound the working memory; what is new in all of them is merged together.
        cuts, keys, starts, new_keys, new_at, done = [0], [], [], [], [], 0
        while cuts[-1] < len(bounds) - 1:
            j = int(np.searchsorted(bounds, bounds[cuts[-1]] + BLOCK, side="right")) - 1
            cuts.append(max(j, cuts[-1] + 1))
        first = np.zeros(len(bounds), np.int64)
        for i, j in zip(cuts, cuts[1:]):
            lo, hi = int(bounds[i]), int(bounds[j])
            begin, key, own = self.pretokens(data[lo:hi], bounds[i : j + 1] - lo)
            first[i : j + 1] = own + done
            unique, index = np.unique(key, return_index=True)
            at = np.searchsorted(self.keys, unique)
            known = np.zeros(len(unique), bool)
            if len(self.keys):
                known = self.keys[np.minimum(at, len(self.keys) - 1)] == unique
            new_keys.append(unique[~known])
            new_at.append(index[~known] + done)
            keys.append(key)
            starts.append(begin + lo)
            done += len(begin)
        if not keys:
            return np.zeros(0, np.int64), first
        key, start = np.concatenate(keys), np.concatenate(starts)
        length = np.diff(np.append(start, bounds[-1]))
        fresh, index = np.unique(np.concatenate(new_keys), return_index=True)
        if len(fresh):
            at = np.concatenate(new_at)[index]
            slot = self.learn(data, start[at], length[at])
            keys, slots = np.concatenate([self.keys, fresh]), np.concatenate([self.slot, slot])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], slots[order]
        slot = self.slot[np.searchsorted(self.keys, key)]
        # A hash is a hint only: those that aren't the very bytes of their slot get another one.
        fine = length == self.seen_length[slot]
        for lo in range(0, len(slot), BLOCK):
            rows = lo + np.flatnonzero(fine[lo : lo + BLOCK])
            fine[rows] = same_bytes(data, start[rows], self.seen, self.seen_at[slot[rows]], length[rows])
        for i in np.flatnonzero(~fine):
            own = data[start[i] : start[i] + length[i]].tobytes()
            if own not in self.clashing:
                self.clashing[own] = int(self.learn(data, start[i : i + 1], length[i : i + 1])[0])
            slot[i] = self.clashing[own]
        return slot, first

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of the texts in them."""
        slot, first = self.slots(data, bounds)
        count = self.count[slot]
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.ids[ragged(self.begin[slot], count)], ends[first]

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        slot, first = self.slots(data, bounds)
        return np.diff(np.concatenate([[0], np.cumsum(self.count[slot])])[first])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)
