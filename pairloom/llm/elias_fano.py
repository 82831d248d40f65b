"""Monotone sequences in Elias-Fano code, and a two-level n-gram trie of such levels in one flat buffer."""

from __future__ import annotations

import mmap

import numpy as np

STEPS, FLOOR = 65535, -20.0
#: The place of the r-th one of a byte.
PLACE = np.zeros((256, 8), np.int64)
for _b in range(256):
    _ones = [k for k in range(8) if _b >> k & 1]
    PLACE[_b, : len(_ones)] = _ones
#: Numbers coded at once; a multiple of 8, so that a piece ends with a byte.
PIECE = 1 << 16


def quantised(log10: np.ndarray) -> np.ndarray:
    """Steps of 20 / 65535 from 10^-20 upwards; 0 stands for nothing."""
    return np.clip(np.rint((log10 - FLOOR) * (STEPS / -FLOOR)), 1, STEPS).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return q * (-FLOOR / STEPS) + FLOOR


class EliasFano:
    """A monotone sequence of 64-bit numbers: lower bits side by side, upper bits as the places of ones.

    `rank` holds the ones before each 64-bit word of the upper bits and `near` the word of every 32nd one, so a number
    is found by a few steps from word to word and a look into one of them; nothing is unpacked as a whole. All arrays
    may be views of a memory map.
    """

    PARTS = ("low", "high", "rank", "near", "meta")

    @staticmethod
    def encode(x: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(x)
        low_bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        upper = (x >> np.uint64(low_bits)).astype(np.int64)
        size = n + ((universe - 1) >> low_bits) + 1 if n else 0
        high = np.zeros(-(-size // 64) * 8, np.uint8)
        place = upper + np.arange(n)
        np.bitwise_or.at(high, place >> 3, (1 << (place & 7)).astype(np.uint8))
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = [np.packbits(((x[i : i + PIECE, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") for i in range(0, n, PIECE)] if low_bits else []
        ones = np.bitwise_count(high.view(np.uint64)).astype(np.int64)
        return {"low": np.concatenate([*low, np.zeros(16, np.uint8)]), "high": high.view(np.uint64), "rank": (np.cumsum(ones) - ones).astype(np.uint32), "near": (place[::32] >> 6).astype(np.uint32), "meta": np.array([n, low_bits], np.int64)}

    def __init__(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray, near: np.ndarray, meta: np.ndarray):
        self.low, self.high, self.rank, self.near = low, high, rank, near
        self.n, self.low_bits = int(meta[0]), int(meta[1])
        # eight bytes from every byte on
        self.windows = np.ndarray((len(low) - 8,), "<u8", low, 0, (1,))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        word, last = self.near[i >> 5].astype(np.int64), len(self.rank) - 1
        further = np.flatnonzero((word < last) & (self.rank[np.minimum(word + 1, last)] <= i))
        while len(further):
            word[further] += 1
            at = word[further]
            further = further[(at < last) & (self.rank[np.minimum(at + 1, last)] <= i[further])]
        left, bits, place = i - self.rank[word], self.high[word], word * 64
        for width in (32, 16, 8):
            lower = bits & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(lower)
            beyond = left >= ones
            left = left - np.where(beyond, ones, 0)
            place += np.where(beyond, width, 0)
            bits = np.where(beyond, bits >> np.uint64(width), lower)
        upper = (place + PLACE[bits & np.uint64(255), left] - i).astype(np.uint64)
        if not self.low_bits:
            return upper
        bit = i * self.low_bits
        found = self.windows[bit >> 3] >> (bit & 7).astype(np.uint64)
        if self.low_bits > 57:  # the window of eight bytes may end before the number does
            shift = bit & 7
            over = np.flatnonzero(shift)
            found[over] |= self.low[(bit[over] >> 3) + 8].astype(np.uint64) << (64 - shift[over]).astype(np.uint64)
        return (upper << np.uint64(self.low_bits)) | (found & np.uint64((1 << self.low_bits) - 1))

    def first_from(self, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
        """The first place in low..high whose number is not smaller than wanted; numbers there lie in below..above.

        Interpolation, as the numbers are hashes, and halving in turn.
        """
        if len(wanted) > PIECE // 2:  # pieces that stay in a processor's cache
            cuts = [slice(i, i + PIECE // 2) for i in range(0, len(wanted), PIECE // 2)]
            return np.concatenate([self.first_from(wanted[c], low[c], high[c], below[c], above[c]) for c in cuts])
        low, high = low.astype(np.int64).copy(), high.astype(np.int64).copy()
        a, b = below.astype(np.float64), above.astype(np.float64)
        open_, turn = np.flatnonzero(low < high), 0
        while len(open_):
            lo, hi = low[open_], high[open_]
            if turn % 3 < 2:
                share = (wanted[open_].astype(np.float64) - a[open_]) / np.maximum(1.0, b[open_] - a[open_])
                mid = lo + np.clip((share * (hi - lo)).astype(np.int64), 0, hi - lo - 1)
            else:
                mid = (lo + hi) >> 1
            value = self[mid]
            less, same = value < wanted[open_], value == wanted[open_]
            low[open_] = np.where(less, mid + 1, np.where(same, mid, lo))
            high[open_] = np.where(less, hi, mid)
            a[open_] = np.where(less, value.astype(np.float64), a[open_])
            b[open_] = np.where(less, b[open_], value.astype(np.float64))
            open_, turn = open_[low[open_] < high[open_]], turn + 1
        return low


class Trie:
    """Contexts, by hash, and their successors, by hash relative to the context.

    Levels: the sorted contexts with a quantised backoff weight each and monotone pointers to their successors; the
    successors, made monotone by the rank of their context, with a quantised log10 probability each. A buffer of bytes
    holds it all: one in memory, a column of a table, or a file mapped by numpy.memmap.
    """

    #: Bits of a context's and of a successor's hash.
    CONTEXT_BITS, BITS = 48, 40
    LEVELS = ("contexts", "pointers", "successors")

    @staticmethod
    def build(contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, log10: np.ndarray, backoff: np.ndarray) -> mmap.mmap:
        """contexts sorted; successors[starts[i] : starts[i + 1]], sorted, belong to context i. Into an anonymous map."""
        owner = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(starts))
        coded = {
            "contexts": EliasFano.encode(contexts, 1 << Trie.CONTEXT_BITS),
            "pointers": EliasFano.encode(starts.astype(np.uint64), len(successors) + 1),
            "successors": EliasFano.encode(owner << np.uint64(Trie.BITS) | successors, max(1, len(contexts)) << Trie.BITS),
        }
        parts = [coded[level][part] for level in Trie.LEVELS for part in EliasFano.PARTS] + [quantised(log10), quantised(backoff)]
        head = 16 * len(parts)
        sizes = [-(-p.nbytes // 8) * 8 for p in parts]
        out = mmap.mmap(-1, max(1, head + sum(sizes)))
        at = head
        for k, (p, size) in enumerate(zip(parts, sizes, strict=True)):
            out[16 * k : 16 * k + 16] = np.array([at, p.nbytes], np.int64).tobytes()
            out[at : at + p.nbytes] = np.ascontiguousarray(p).tobytes()
            at += size
        return out

    def __init__(self, buffer):
        data = buffer if isinstance(buffer, np.ndarray) else np.frombuffer(buffer, np.uint8)
        kinds = [np.uint8, np.uint64, np.uint32, np.uint32, np.int64] * len(self.LEVELS) + [np.uint16, np.uint16]
        places = data[: 16 * len(kinds)].view(np.int64).reshape(-1, 2)
        parts = [data[at : at + n].view(kind) for (at, n), kind in zip(places.tolist(), kinds, strict=True)]
        self.contexts, self.pointers, self.successors = (EliasFano(*parts[5 * k : 5 * k + 5]) for k in range(3))
        self.log10, self.backoff = parts[15], parts[16]

    def context(self, x: np.ndarray) -> np.ndarray:
        """The rank of each context, -1 for those that are not there."""
        n = self.contexts.n
        at = self.contexts.first_from(x, np.zeros(len(x), np.int64), np.full(len(x), n), np.zeros(len(x)), np.full(len(x), 2.0**self.CONTEXT_BITS))
        inside = np.flatnonzero(at < n)
        out = np.full(len(x), -1)
        hit = inside[self.contexts[at[inside]] == x[inside]]
        out[hit] = at[hit]
        return out

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The quantised log10 of each word after the context of that rank; 0 for those that are not there."""
        out = np.zeros(len(word), np.uint16)
        known = np.flatnonzero(context >= 0)
        if not len(known):
            return out
        rank = context[known]
        low, high = self.pointers[rank].astype(np.int64), self.pointers[rank + 1].astype(np.int64)
        base = rank.astype(np.uint64) << np.uint64(self.BITS)
        wanted = base | word[known]
        at = self.successors.first_from(wanted, low, high, base, base + np.uint64((1 << self.BITS) - 1))
        inside = np.flatnonzero(at < high)
        hit = inside[self.successors[at[inside]] == wanted[inside]]
        out[known[hit]] = self.log10[at[hit]]
        return out
