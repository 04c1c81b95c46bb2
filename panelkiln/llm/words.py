"""Hashes of the words of a text, by numpy over its bytes."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: White space of the word contract: space and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters.
NO_LETTERS = np.zeros(256, bool)
NO_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = True

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _random(256, 11)[_LOWER] | np.uint64(1)
_PLACE = _random(1 << 12, 23)
#: Bytes of a text that are looked at together; memory follows it, not the text.
SEGMENT = 1 << 20


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = _random(1 << int(n - 1).bit_length(), 23)
    return _PLACE


def _hash(data: np.ndarray, parts: np.ndarray, prefixes: tuple[int, ...], with_starts: bool = False) -> list[np.ndarray]:
    word = ~parts[data]
    edge = np.diff(word.astype("i1"), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.zeros(0, "u8") for _ in range(1 + len(prefixes) + with_starts)]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    term = _BYTE[data[word]] * _places(int(sizes.max()))[at]
    seal = lambda h, n: mix(h + n.astype("u8") * np.uint64(0xD6E8FEB86659FD93))
    out = [seal(np.add.reduceat(term, first), sizes)]
    for k in prefixes:
        long = sizes > k
        h = np.add.reduceat(np.where(at < k, term, np.uint64(0)), first)[long]
        out.append(seal(h, np.full(len(h), (1 << 40) + k)))
    return [*out, starts] if with_starts else out


def word_hashes(text: str, parts: np.ndarray = SPACES, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of the words in order, A-Z lower-cased, and for each length in `prefixes` those of so many first bytes of longer words.

    Words are what stands between the bytes marked in `parts` (all ASCII). Each byte's random number times one of its place, summed
    mod 2**64 and mixed with the length: different words share a hash with a chance of about 2**-63.
    """
    data = np.frombuffer(text.encode("utf-8", "replace"), "u1")
    if len(data) <= SEGMENT:
        return _hash(data, parts, prefixes)
    found, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data):
            seam = np.flatnonzero(parts[data[end : end + SEGMENT]])
            if len(seam):
                end += int(seam[0])
                break
            end = min(end + SEGMENT, len(data))
        found.append(_hash(data[at:end], parts, prefixes))
        at = end
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def word_hashes_of(texts: list[str], parts: np.ndarray = SPACES) -> list[np.ndarray]:
    """word_hashes of each text, short texts together; U+000A must part words."""
    out: list[np.ndarray] = []
    some: list[bytes] = []
    size = 0

    def together() -> None:
        nonlocal some, size
        if some:
            h, starts = _hash(np.frombuffer(b"\n".join(some), "u1"), parts, (), True)
            ends = np.cumsum([len(x) + 1 for x in some])
            out.extend(np.split(h, np.searchsorted(starts, ends[:-1])))
        some, size = [], 0

    for text in texts:
        if len(text) > SEGMENT // 4:
            together()
            out += word_hashes(text, parts)
            continue
        some.append(text.encode("utf-8", "replace"))
        size += len(some[-1])
        if size >= SEGMENT // 2:
            together()
    together()
    return out
