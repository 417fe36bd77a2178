"""Hashed word shingles of many texts at once, and exact Jaccard similarity inside a small group."""

from __future__ import annotations

import numpy as np

#: Text bytes that are hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit values of a seed."""
    start = (seed * 0x632BE59BD9B4E019) % 2**64
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(start))


_BYTE = constants(11, 256)
_INVERSE = np.uint64(pow(_ODD, -1, 2**64))


def _powers(base: int | np.uint64, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, 1 << 16), _powers(_INVERSE, 1 << 16)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = _SPACE[raw]
    inside = ~gap
    start = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    end = np.flatnonzero(inside & np.concatenate((gap[1:], [True]))) + 1
    # sums of value * power over blocks of positions; words are taken relative to their start, so powers stay in a table
    width = end - start
    total = np.zeros(len(start), dtype=np.uint64)
    longest = int(width.max())
    if longest <= 48:
        for k in range(longest):
            has = width > k
            total[has] += _BYTE[raw[start[has] + k]] * _UP[k]
    else:
        up = _UP if len(raw) <= len(_UP) else _powers(_ODD, len(raw))
        down = _DOWN if len(raw) <= len(_DOWN) else _powers(_INVERSE, len(raw))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
        total = (sums[end] - sums[start]) * down[start]
    return mix(total + width.astype(np.uint64)), start


def shingles(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, ends)``: shingle hashes of all texts in order, repeats included, and where each text's end.

    Words are runs without ASCII white space. A text of fewer than ``n`` words has one shingle of all its words; null
    and texts without words have none.
    """
    factors = constants(23, n + 1) | np.uint64(1)
    parts, counts = [], []
    with np.errstate(over="ignore"):
        at = 0
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        while at < len(coded):
            to, size = at + 1, len(coded[at])
            while to < len(coded) and size + len(coded[to]) <= CHUNK_BYTES:
                size += len(coded[to]) + 1
                to += 1
            word, start = _words(b"\n".join(coded[at:to]))
            begins = np.cumsum([0, *(len(c) + 1 for c in coded[at:to])])
            first = np.searchsorted(start, begins)  # index of each text's first word
            n_words = np.diff(first)
            n_out = np.where(n_words >= n, n_words - n + 1, np.minimum(n_words, 1))
            total = int(n_out.sum())
            if total:
                owner = np.repeat(np.arange(to - at), n_out)
                lead = first[:-1][owner] + np.arange(total) - np.concatenate(([0], np.cumsum(n_out)[:-1]))[owner]
                left = first[1:][owner] - lead  # words from here to the text's end
                value = np.zeros(total, dtype=np.uint64)
                for k in range(n):
                    has = left > k
                    value[has] += word[lead[has] + k] * factors[k]
                value += np.minimum(left, n).astype(np.uint64) * factors[n]
                parts.append(mix(value))
            counts.append(n_out)
            at = to
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.cumsum(np.concatenate(counts)) if counts else np.zeros(0, dtype=np.int64)


def jaccard_pairs(texts: list[str], threshold: float, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions left < right of the pairs whose sets of shingles have a Jaccard similarity of at least ``threshold``, and
    the similarities.

    Overlaps are counted by products of 0/1 matrices over slices of the shingles that two texts or more share.
    """
    hashes, ends = shingles(texts, n)
    sets = [np.unique(x) for x in np.split(hashes, ends[:-1])] if len(ends) else []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) == 2:
        same = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        union = int(sizes.sum()) - same
        hit = int(bool(union) and same / union >= threshold)
        return np.zeros(hit, int), np.ones(hit, int), np.full(hit, same / max(1, union))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = max(256, (1 << 22) // max(1, len(sets)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, (low, low + step))
        block = np.zeros((len(sets), step), dtype=np.float32)
        block[owner[i:j], column[i:j] - low] = 1
        overlap += block @ block.T
    overlap = overlap.astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - overlap
    likeness = overlap / np.maximum(union, 1)
    left, right = np.nonzero(np.triu((union > 0) & (likeness >= threshold), 1))
    return left, right, likeness[left, right]
