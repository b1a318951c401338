"""Aho-Corasick automata over the pieces of names, as flat arrays that match many texts at once.

A text is cut into pieces: runs of letters, digits and underscores, and every other character alone. Pieces are told by
a digest of their code points, so cutting, numbering and stepping are array operations. Runs of pieces that names use go
through the automaton side by side, one piece of each at a time; a run longer than SEGMENT is cut with enough overlap
for the longest name.
"""

from __future__ import annotations

import pickle
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

SEGMENT = 256
_BASE = 0x9E3779B97F4A7C15


@cache
def word_table() -> np.ndarray:
    """Which code points are letters, numbers or the underscore."""
    table = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    table[ord("_")] = True
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Pieces:
    """Pieces of some texts: where each begins and ends among all code points, whether it is a word, its digest, and its text."""

    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    digest: np.ndarray
    text: np.ndarray
    base: np.ndarray  # where each text begins
    joined: str


def pieces(texts: list[str]) -> Pieces:
    """Pieces of texts, which never cross from one text to the next."""
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    word = word_table()[code]
    new = np.ones(len(code), bool)
    new[1:] = ~(word[1:] & word[:-1])
    new[base[base < len(code)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(code))[: len(start)]
    # a sum over the piece of the digest of each character with its place in it
    place = np.arange(len(code), dtype=np.uint64) - np.repeat(start, end - start).astype(np.uint64)
    own = _mix(code.astype(np.uint64) * np.uint64(_BASE) + place * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
    digest = _mix(np.add.reduceat(own, start) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    text = np.searchsorted(base, start, "right") - 1
    return Pieces(start, end, word[start] if len(start) else np.zeros(0, bool), digest, text, base, joined)


class Automaton:
    """States are beginnings of names, breadth first; the root is 0.

    ``key`` holds the sorted edges state * width + piece, ``child`` where they lead, ``fail`` the state of the longest proper
    ending of each, ``out`` the longest ending that is a name, ``name`` the name that ends there, or -1.
    """

    def __init__(self, names: list[str], ids: list[int]):
        self.names, self.ids = names, np.array(ids, np.int64)
        p = pieces(names)
        self.digest, token = np.unique(p.digest, return_inverse=True)
        first = np.searchsorted(p.text, np.arange(len(names) + 1))
        size = np.diff(first)
        self.longest, self.width = int(size.max(initial=0)), len(self.digest)
        state = np.zeros(len(names), np.int64)
        self.depth, parents, tokens, count = [np.zeros(1, np.int64)], [], [], 1
        name = {}
        for d in range(self.longest):
            alive = np.flatnonzero(size > d)
            edge, which = np.unique(state[alive] * self.width + token[first[alive] + d], return_inverse=True)
            parents.append(edge // self.width)
            tokens.append(edge % self.width)
            state[alive] = count + which
            done = alive[size[alive] == d + 1]
            name.update(zip(state[done].tolist(), done.tolist(), strict=True))
            self.depth.append(np.full(len(edge), d + 1))
            count += len(edge)
        self.depth = np.concatenate(self.depth)
        parent = np.concatenate([np.zeros(0, np.int64), *parents])
        token = np.concatenate([np.zeros(0, np.int64), *tokens])
        key = parent * self.width + token
        order = np.argsort(key)
        self.key, self.child = key[order], order + 1
        self.name = np.full(count, -1, np.int64)
        self.name[list(name)] = list(name.values())
        self.fail, self.out = np.zeros(count, np.int64), np.zeros(count, np.int64)
        at = 1
        for d, edge in enumerate(parents):
            here = np.arange(at, at + len(edge))
            if d:
                self.fail[here] = self.step(self.fail[edge], tokens[d])
            up = self.fail[here]
            self.out[here] = np.where(self.name[up] >= 0, up, self.out[up])
            at += len(edge)

    def step(self, state: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The next state of each, along endings where there is no edge."""
        out, left, now = np.zeros_like(state), np.arange(len(state)), state.copy()
        while len(left):
            key = now * self.width + piece[left]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[at] == key
            out[left[found]] = self.child[at[found]]
            go = ~found & (now > 0)
            left, now = left[go], self.fail[now[go]]
        return out

    def matches(self, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first piece, pieces, name) of every place where the digests of a name's pieces stand."""
        none = np.zeros(0, np.int64)
        if not self.width or not len(p.digest):
            return none, none, none
        token = np.minimum(np.searchsorted(self.digest, p.digest), self.width - 1)
        known = self.digest[token] == p.digest
        # runs of pieces that names use, within one text
        edge = known.copy()
        edge[1:] &= ~known[:-1] | (p.text[1:] != p.text[:-1])
        last = known.copy()
        last[:-1] &= ~known[1:] | (p.text[1:] != p.text[:-1])
        start, end = np.flatnonzero(edge), np.flatnonzero(last) + 1
        # long runs are cut; each part but the first begins early enough for a name that ends in it
        size = max(SEGMENT, 4 * self.longest)
        parts = -(-(end - start) // size)
        run = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        own = start[run] + nth * size
        stop = np.minimum(own + size, end[run])
        begin = np.maximum(own - self.longest + 1, start[run])
        order = np.argsort(begin - stop, kind="stable")
        begin, stop, own = begin[order], stop[order], own[order]
        length = stop - begin
        state, found = np.zeros(len(begin), np.int64), []
        for t in range(int(length.max(initial=0))):
            alive = int(np.searchsorted(-length, -t, "left"))
            state = self.step(state[:alive], token[begin[:alive] + t])
            at, s = np.arange(alive), state
            hit = (self.name[s] >= 0) | (self.out[s] > 0)
            at, s = at[hit], s[hit]
            s = np.where(self.name[s] >= 0, s, self.out[s])
            while len(s):
                last_piece = begin[at] + t
                good = last_piece >= own[at]
                found.append((last_piece[good] - self.depth[s[good]] + 1, self.depth[s[good]], self.name[s[good]]))
                s = self.out[s]
                at, s = at[s > 0], s[s > 0]
        if not found:
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def found(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text, start, end, id, first piece, last piece) of all names between word boundaries, in order of place, longest first.

        Texts and names are in lower case. A name that begins or ends with a sign needs no letter beside it either. Offsets are in characters.
        """
        p = pieces(texts)
        first, size, name = self.matches(p)
        last = first + size - 1
        same = lambda a, b: (b >= 0) & (b < len(p.text)) & (p.text[np.clip(b, 0, len(p.text) - 1)] == p.text[a])
        word = lambda a, b: same(a, b) & p.word[np.clip(b, 0, len(p.text) - 1)]
        free = ~word(first, first - 1) & ~word(first, last + 1)
        first, last, name = first[free], last[free], name[free]
        text = p.text[first]
        start, end = p.start[first], p.end[last]
        # digests find names, characters decide
        good = np.fromiter((p.joined[a:b] == self.names[n] for a, b, n in zip(start.tolist(), end.tolist(), name.tolist(), strict=True)), bool, len(name))
        order = np.lexsort((self.ids[name[good]], -last[good], first[good]))
        pick = np.flatnonzero(good)[order]
        return text[pick], start[pick] - p.base[text[pick]], end[pick] - p.base[text[pick]], self.ids[name[pick]], first[pick] - np.searchsorted(p.text, text[pick]), last[pick] - np.searchsorted(p.text, text[pick])

    def dump(self) -> bytes:
        return pickle.dumps(self, protocol=5)


def load(data: bytes) -> Automaton:
    return pickle.loads(data)  # noqa: S301  made by this library within the same job


def leftmost_longest(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of sorted matches stay: from left to right the longest of each place; a piece stands between two that stay."""
    keep, now, end = np.zeros(len(text), bool), -1, -2
    for i, (t, a, b) in enumerate(zip(text.tolist(), first.tolist(), last.tolist(), strict=True)):
        if t != now:
            now, end = t, -2
        if a > end + 1:
            keep[i], end = True, b
    return keep
