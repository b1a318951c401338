"""Words of many texts at once, as numpy arrays: where they are, and 128 bits that stand for the bytes of each.

Words of up to 15 bytes stand for themselves: their bytes and length fill the 128 bits, so two of them are equal
exactly if these are. A longer word has 120 bits of its BLAKE2b digest and a mark that no short word has.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Bytes between words, by word class.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALPHANUMERIC = np.ones(256, bool)
NOT_ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Bytes of the longest word that stands for itself; the mark of a digest, where such a word has its length.
SHORT, DIGEST = 15, np.uint64(0xFF << 56)
_STEP = 0xD1342543DE82EF95
#: Masks of the lowest n bytes of a number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ np.uint64((seed * _STEP) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit digest of two numbers in order: one to one in b for each a."""
    return mix(mix(a, seed) + b, seed + 1)


def eights(data: bytes | np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number; beyond the end come zeros."""
    padded = np.concatenate([np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data, np.zeros(16, np.uint8)])
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


@dataclass
class Words:
    """Words of the joined texts: byte ranges, the text each is in, the two halves of the number that stands for each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # of each text, and one more: number of its first word
    base: np.ndarray  # of each text: where its bytes begin

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit digest of each word."""
        return pair(self.low, self.high)


def words_of(texts: list[bytes], between: np.ndarray, fold: bool = False) -> Words:
    """Words of the texts, which never cross from one text to the next; ``fold`` lower-cases A to Z."""
    joined = b"\n".join(texts) + b"\n"
    joined = joined.lower() if fold else joined
    data = np.frombuffer(joined, np.uint8)
    inside = ~between[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    base = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
    size, at = end - start, eights(data)
    low = at[start] & _LOW[np.minimum(size, 8)]
    high = at[np.minimum(start + 8, len(data))] & _LOW[np.clip(size - 8, 0, 7)]
    high |= size.astype(np.uint64) << np.uint64(56)
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(joined[start[i] : end[i]], digest_size=16).digest()
        low[i], high[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | int(DIGEST)
    first = np.searchsorted(start, base)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, text, low, high, first, base[:-1])


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of ``size`` consecutive words of one text start, and two 64-bit digests of each word sequence.

    Digests of runs of 1, 2, 4, ... words are made from those of half the length, and joined to the wanted one.
    """
    n = len(words.text) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
    out = []
    for lane in (1, 2):
        run = pair(words.low, words.high, 10 * lane) if lane == 1 else pair(words.high, words.low, 10 * lane)
        whole, done, length = None, 0, 1
        while True:
            if size & length:
                whole = run[:n] if whole is None else pair(whole, run[done : done + n], 100 * lane + length)
                done += length
            if 2 * length > size:
                break
            run = pair(run[:-length], run[length:], 200 * lane + length)
            length *= 2
        out.append(whole[at])
    return at, *out


def covered(starts: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in a window that starts at one of ``starts``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0
