"""Byte-pair merging of one pre-token, shared by the token operators."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import regex

#: The public pattern of such tokenizers with its classes as parameters, letters first: the branches start with different characters, so
#: their order only decides how soon the common ones match; possessive, as no match here is ever shortened.
PATTERN = r" ?[{letters}]++| ?[{digits}]++|'(?:[stmd]|re|ve|ll)| ?[^{space}{letters}{digits}]++|[{space}]+(?![^{space}])|[{space}]+"
#: Up to here pattern modules and libraries know the same characters, and the standard module, the fastest, takes them spelt out.
LATIN = 0x250


def _class(chars: str) -> str:
    """The inside of a character class, as ranges."""
    codes = sorted(map(ord, chars))
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


@lru_cache(maxsize=1)
def _latin():
    chars = "".join(map(chr, range(LATIN)))
    letters, digits, space = (_class("".join(regex.findall(p, chars))) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(PATTERN.format(letters=letters, digits=digits, space=space)).findall


@lru_cache(maxsize=2)
def _unlike(known: Callable[[str], tuple[str, str]]) -> dict[int, str]:
    """Characters that the library and the pattern module class differently, each with a stand-in of the library's class that is in no contraction."""
    chars = "".join(chr(i) for i in range(LATIN, 0x110000) if not 0xD800 <= i < 0xE000)
    own = [set(regex.findall(p, chars)) for p in (r"\p{L}", r"\p{N}")]
    theirs = [set(x) for x in known(chars)]
    odd = (own[0] ^ theirs[0]) | (own[1] ^ theirs[1])
    return {ord(c): "a" if c in theirs[0] else "0" if c in theirs[1] else "\u2020" for c in odd}


def _cut(text: str, pieces: list[str]) -> list[str]:
    """``text`` cut where a text of equal length is; all of it is covered, for every character matches some branch."""
    at, out = 0, []
    for p in pieces:
        out.append(text[at : at + len(p)])
        at += len(p)
    return out


def splitter(known: Callable[[str], tuple[str, str]]) -> Callable[[str], list[str]]:
    """Text to pre-tokens. Beyond Latin letters the tables of the library whose results are wanted decide: ``known`` picks its letters and digits out of a text."""
    latin, beyond = _latin(), re.compile(f"[\\U{LATIN:08x}-\U0010ffff]").search
    quick = regex.compile(PATTERN.format(letters=r"\p{L}", digits=r"\p{N}", space=r"\s")).findall

    @lru_cache(maxsize=1)
    def unlike():
        table = _unlike(known)
        return table, re.compile(f"[{_class(''.join(map(chr, table)))}]").search if table else (lambda text: None)

    def split(text: str) -> list[str]:
        if beyond(text) is None:
            return latin(text)
        table, odd = unlike()
        return quick(text) if odd(text) is None else _cut(text, quick(text.translate(table)))

    return split


#: The rank of neighbours that never join.
NEVER = 1 << 60


def merge(parts: Sequence, rank: Callable, join: Callable) -> list:
    """Joins the neighbours of lowest rank, leftmost first, until none of them has a rank.

    Ranks are kept beside the parts and renewed around each join only. Beyond 64 parts a heap over a linked
    list keeps a run of n parts at n log n steps.
    """
    items = list(parts)
    n = len(items)
    if n < 2:
        return items
    ranks = list(map(rank, items, items[1:]))
    if n <= 64:
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            items[i : i + 2] = [join(items[i], items[i + 1])]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(items[i - 1], items[i])
            if i < len(ranks):
                ranks[i] = rank(items[i], items[i + 1])
        return items
    after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap = [(r, i, 0, 0) for i, r in enumerate(ranks) if r != NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if items[i] is None or j >= n or version[i] != left or version[j] != right:
            continue
        items[i] = join(items[i], items[j])
        items[j] = None
        version[i] += 1
        version[j] += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(items[i], items[k])) != NEVER:
                heapq.heappush(heap, (r, i, version[i], version[k]))
        h = before[i]
        if h >= 0 and (r := rank(items[h], items[i])) != NEVER:
            heapq.heappush(heap, (r, h, version[h], version[i]))
    return [x for x in items if x is not None]


class Remembered(dict):
    """A table that fills itself by ``find``. When it is full it becomes the old half, asked before ``find``, and a new half begins.

    So memory stays bounded by two halves of ``most`` keys, and keys in use stay. ``fixed`` is kept beside them.
    """

    def __init__(self, find: Callable, fixed: dict | None = None, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.find, self.fixed, self.most, self.longest, self.old = find, fixed or {}, most, longest, {}

    def __missing__(self, key):
        value = self.fixed.get(key)
        if value is None:
            value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
