"""The byte-level tokenizers' split into pre-tokens, vectorised over many texts at once.

It gives the matches of ``public_tokenizers.PATTERN`` (contractions, letters, numbers,
other signs, each with one leading space, and white space) without running a regular
expression over the text: bytes are looked up in a table of character classes
and the places where matches start follow from class changes. Pre-tokens of up to
``SHORT`` bytes become two 64-bit numbers, by which whole arrays of them are found in hash tables.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np

OTHER, LETTER, NUMBER, SPACE, BOUNDARY = 0, 1, 2, 3, 4

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe in a contraction.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")

#: Bytes of a pre-token that two 64-bit numbers hold beside its length.
SHORT = 15
#: Entries of a worker's memory, in each of two generations.
REMEMBERED = 1 << 18
# Odd multipliers of the tables' hash.
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        out[cp] = kinds.get(unicodedata.category(chr(cp))[0], OTHER)
    out[WHITE_SPACE] = SPACE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    kind = np.append(classes()[:128], np.zeros(128, np.uint8))[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        cp = first & (0x3F >> more)
        for i in (1, 2, 3):
            has = more >= i
            cp[has] = cp[has] << 6 | data[lead[has] + i] & 0x3F
        own = classes()[cp]
        for i in range(4):
            has = more >= i
            kind[lead[has] + i] = own[has]
    return kind


class Pretokens:
    """The pre-tokens of texts: their places in the joined bytes ``data``, which of them are each text's
    (``first``, n + 1 values), and their keys (``lo``, ``hi``; ``hi`` is 0 for those longer than ``SHORT``)."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "replace") for t in texts]
        self.bytes = b"\x00".join([*parts, bytes(2 * SHORT)])
        data = self.data = np.frombuffer(self.bytes, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        used = int(ends[-1]) + 1 if len(ends) else 0
        data = data[:used]
        kind = byte_classes(data)
        kind[ends] = BOUNDARY
        start = np.ones(used, bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[ends] = True
        start[ends[:-1] + 1] = True
        # white space before something: its last character is apart, and a plain space joins what follows
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != BOUNDARY))
        start[last[data[last] == 32] + 1] = False
        for _ in range(3):
            last -= (data[last] & 0xC0) == 0x80
        start[last] = True
        # contractions: an apostrophe that starts a match takes one or two letters along
        q = np.flatnonzero((data == ord("'")) & start)
        if len(q):
            a, b = self.data[q + 1], self.data[q + 2]
            one = np.isin(a, [ord(c) for c in ONE_LETTER])
            two = ~one & np.logical_or.reduce([(a == ord(p[0])) & (b == ord(p[1])) for p in TWO_LETTERS])
            for hit, n in ((q[one], 1), (q[two], 2)):
                start[hit + 1] = False
                start[hit + 1 + n] = True
        at = np.flatnonzero(start)
        real = kind[at] != BOUNDARY
        self.first = np.concatenate(([0], np.cumsum(real)[~real]))
        self.begin = at[real]
        self.size = np.diff(at, append=used)[real]
        self.lo, self.hi = keys(self.bytes, self.begin, self.size)

    def __len__(self) -> int:
        return len(self.begin)

    def piece(self, i: int) -> bytes:
        return self.bytes[self.begin[i] : self.begin[i] + self.size[i]]


def keys(data: bytes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each run of bytes; ``data`` goes on for ``2 * SHORT`` bytes after the last. Runs longer than ``SHORT``, and empty ones, get zeros."""
    words = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    fits = size <= SHORT
    lo = np.where(fits, words[begin] & LOWEST[np.minimum(size, 8)], 0)
    hi = np.where(fits, words[begin + 8] & LOWEST[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56), 0)
    return lo, hi


def keys_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return keys(b"".join([*pieces, bytes(2 * SHORT)]), np.cumsum(size) - size, size)


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def hashes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = lo * MIX
        h ^= h >> np.uint64(29)
        h = (h + hi) * MIX2
        h ^= h >> np.uint64(32)
        h *= MIX
        return h ^ h >> np.uint64(31)


def distinct(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each distinct key, and for every key which of those it is."""
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Table:
    """An open-addressed hash table from short pre-tokens' keys to numbers, probed for whole arrays at once.

    It holds up to ``entries`` keys, each in one of at least twice as many slots, so probes stay short.
    """

    def __init__(self, entries: int, kind: type = np.int64):
        slots = 1 << max(4, (2 * entries - 1).bit_length())
        self.entries, self.n = entries, 0
        self.lo, self.hi, self.value = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, kind)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 where the table doesn't have it (nor keys of longer pre-tokens)."""
        out = np.full(len(lo), -1, np.int64)
        left = np.flatnonzero(hi)
        slot = (hashes(lo, hi) & np.uint64(len(self.lo) - 1)).astype(np.int64)[left]
        while len(left):
            own = self.hi[slot]
            same = (own == hi[left]) & (self.lo[slot] == lo[left])
            out[left[same]] = self.value[slot[same]]
            go = ~same & (own != 0)
            left, slot = left[go], slot[go] + 1 & len(self.lo) - 1
        return out

    def add(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> None:
        """Put in distinct keys that the table doesn't have (as many as it has entries left for)."""
        left = np.arange(min(len(lo), self.entries - self.n))
        self.n += len(left)
        slot = (hashes(lo, hi) & np.uint64(len(self.lo) - 1)).astype(np.int64)[left]
        while len(left):
            free = np.flatnonzero(self.hi[slot] == 0)
            taken, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.lo[taken], self.hi[taken], self.value[taken] = lo[left[won]], hi[left[won]], value[left[won]]
            go = np.ones(len(left), bool)
            go[won] = False
            left, slot = left[go], slot[go] + 1 & len(self.lo) - 1


class Memory:
    """Numbers (at most one a byte) of short pre-tokens that a worker has met, in flat arrays.

    There are two generations: a full one becomes the older one, what is met again moves over, and the rest goes.
    """

    def __init__(self, entries: int = REMEMBERED):
        self.entries = entries
        self.new, self.old = self.generation(), self.generation()

    def generation(self) -> tuple[Table, list]:
        return Table(self.entries), [np.zeros(1 << 12, np.uint32), 0]

    @staticmethod
    def rows(flat: list, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = value & 15
        return flat[0][ranges(value >> 4, sizes)], sizes

    def keep(self, lo: np.ndarray, hi: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> None:
        if self.new[0].n + len(lo) > self.entries:
            self.old, self.new = self.new, self.generation()
        table, flat = self.new
        n = min(len(lo), self.entries)  # a slice of texts with more distinct ones than that
        lo, hi, sizes, used = lo[:n], hi[:n], sizes[:n], flat[1]
        flat[1] += int(sizes.sum())
        if flat[1] > len(flat[0]):
            flat[0] = np.resize(flat[0], max(flat[1], 2 * len(flat[0])))
        flat[0][used : flat[1]] = numbers[: flat[1] - used]
        table.add(lo, hi, used + np.cumsum(sizes) - sizes << 4 | sizes)

    def of(self, lo: np.ndarray, hi: np.ndarray, ask: Callable[[np.ndarray], list]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all keys one after another, and where each key's begin (n + 1 values); ``ask`` gives, for the indices of distinct unknown keys, their numbers."""
        value = self.new[0].find(lo, hi)
        known = np.flatnonzero(value >= 0)
        groups = [(known, *self.rows(self.new[1], value[known]))]
        missing = np.flatnonzero(value < 0)
        if len(missing):
            one, number = distinct(lo[missing], hi[missing])
            at = missing[one]
            value = self.old[0].find(lo[at], hi[at])
            again = value >= 0
            numbers, sizes = self.rows(self.old[1], value[again])
            got = ask(at[~again])
            numbers = np.concatenate([numbers, np.fromiter((i for x in got for i in x), np.uint32)])
            sizes = np.concatenate([sizes, np.fromiter(map(len, got), np.int64, len(got))])
            order = np.concatenate([np.flatnonzero(again), np.flatnonzero(~again)])
            self.keep(lo[at[order]], hi[at[order]], numbers, sizes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            own = place[number]
            groups.append((missing, numbers[ranges((np.cumsum(sizes) - sizes)[own], sizes[own])], sizes[own]))
        return placed(len(lo), groups)


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices ``begin[i] .. begin[i] + sizes[i] - 1``, one i after another."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - sizes), sizes)


def placed(n: int, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``n`` pre-tokens in order, from groups of (indices, their numbers, how many each has), and where each pre-token's begin (n + 1 values)."""
    sizes = np.zeros(n, np.int64)
    for at, _, lengths in groups:
        sizes[at] = lengths
    begin = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(begin[-1]), np.uint32)
    for at, numbers, lengths in groups:
        out[ranges(begin[at], np.broadcast_to(lengths, at.shape))] = numbers
    return out, begin
