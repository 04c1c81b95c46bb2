"""Signatures by which similar sets of equal-size bands meet: partitions of the feature domain and subsets of them."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

from panelkiln.llm.words import mix, word_hashes_of

#: Words of a shingle.
WORDS = 5


def shingles_of(texts: list[str]) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its 5-word shingles; with fewer words, of the whole sequence; none without words."""
    out = []
    for w in word_hashes_of(texts):
        n = min(WORDS, len(w))
        if not n:
            out.append(w)
            continue
        h = np.full(len(w) - n + 1, np.uint64(n), "u8")
        for i in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
        h.sort()
        out.append(h if len(h) == 1 else h[np.concatenate(([True], h[1:] != h[:-1]))])
    return out


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix(np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))], "u8")).view("i8")[0])


@lru_cache(1024)
def _band_end(i: int) -> int:
    """The largest size of band i: each band ends at 4/3 of the last one's end, or one more."""
    return 1 if i <= 0 else max(_band_end(i - 1) + 1, _band_end(i - 1) * 4 // 3)


@lru_cache(1 << 16)
def band_of(size: int) -> int:
    i = 0
    while _band_end(i) < size:
        i += 1
    return i


@lru_cache(4096)
def plan(family: int, percent: int) -> int:
    """The largest Hamming distance of similar sets of a family.

    Family i is for pairs of band i with band i or i + 1. Sets of sizes a <= b are similar only if b <= a * 100 / percent and their Hamming distance is at
    most (100 - percent) / (100 + percent) * (a + b).
    """
    a = _band_end(family)
    b = max(a, min(_band_end(family + 1), a * 100 // percent))
    return (100 - percent) * (a + b) // (100 + percent)


def _projections(s: np.ndarray, family: int, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and sizes of a set's projections on n partitions of the feature domain."""
    seed = mix(np.array([family * 7919 + salt], "u8"))[0]
    h = mix(s ^ seed)
    part = (h % np.uint64(n)).astype("i8")
    order = np.argsort(part, kind="stable")
    p = part[order]
    first = np.flatnonzero(np.diff(p, prepend=-1))
    total = np.zeros(n, "u8")
    total[p[first]] = np.add.reduceat(mix(h + seed)[order], first)
    return mix(total ^ mix(np.arange(n, dtype="u8") + seed)), np.bincount(part, minlength=n)


def spare(k: int) -> int:
    """How many more than one signature similar sets of a family have in common."""
    return k // 8


def signatures(s: np.ndarray, percent: int = 75) -> np.ndarray:
    """One signature per partition: two similar sets, neither empty, have at least shared_at_least() in common.

    Of n partitions of a family at least n - k agree between similar sets, so among the k + 1 + t first ones in any order of signatures that both follow t + 1
    agree. The order takes those with most features first, as chance shares them least.
    """
    out, own = [], band_of(len(s))
    for family in range(max(0, own - 1), own + 1):
        k = plan(family, percent)
        sig, count = _projections(s, family, k + 1 + k // 2, 13)
        out.append(sig[np.lexsort((sig, -count))[: k + 1 + spare(k)]])
    return np.concatenate(out)


def shared_at_least(size: int, percent: int = 75) -> int:
    """Signatures that a set of this size has in common with any similar one."""
    own = band_of(size)
    return 1 + min(spare(plan(f, percent)) for f in range(max(0, own - 1), own + 1))


#: Second-level partitions of each first-level one, and how many of them may differ.
INNER, MAY_DIFFER = 5, 2
_SUBSETS = np.array(list(combinations(range(INNER), INNER - MAY_DIFFER)))


def fine_signatures(s: np.ndarray, percent: int = 75) -> np.ndarray:
    """Signatures of subsets of partitions: fewer strangers share one, and two similar sets, neither empty, still do.

    Each subset of 3 of the 5 inner partitions of a first-level one is a signature. A first-level partition with d of the k differences has at least 5 - d
    inner ones that agree, so at least 3 - d common signatures; with n first-level ones that makes 3 n - k. So in any order of signatures that
    both follow, the sets still share one where each leaves out its last 3 n - k - 1. Those are the ones of fewest features: all sets of a family would meet in
    the signatures of empty partitions, the more the larger the table.
    """
    out, own = [], band_of(len(s))
    for family in range(max(0, own - 1), own + 1):
        k = plan(family, percent)
        outer = k // (MAY_DIFFER + 1) + 1
        outer += (outer + 2) // 6
        sig, count = _projections(s, family, outer * INNER, 29)
        some = sig.reshape(outer, INNER)[:, _SUBSETS]
        h = np.full(some.shape[:2], np.uint64(1), "u8")
        for j in range(some.shape[2]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + some[:, :, j])
        h = mix(h + np.arange(len(_SUBSETS), dtype="u8")).ravel()
        features = count.reshape(outer, INNER)[:, _SUBSETS].sum(2).ravel()
        out.append(h[np.lexsort((h, -features))[: len(h) - (outer * (MAY_DIFFER + 1) - k - 1)]])
    return np.concatenate(out)


def sketch(s: np.ndarray, most_bits: int = 1 << 15) -> bytes:
    """Parities of how many features fall in each cell. The Hamming distance of two sketches is at most that of the sets."""
    m = 64
    while m < 2 * len(s) and m < most_bits:
        m *= 2
    n = np.bincount((mix(s + np.uint64(77)) % np.uint64(m)).astype("i8"), minlength=m) & 1
    return np.packbits(n.astype("u1"), bitorder="little").tobytes()


def least_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the Hamming distance of two sets from their sketches; the larger sketch folds to the smaller."""
    x, y = np.frombuffer(a, "u1"), np.frombuffer(b, "u1")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
