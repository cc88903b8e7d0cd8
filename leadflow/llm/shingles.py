"""Hashed word shingles of whole batches of texts, in numpy.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased. A word's hash is a polynomial over its bytes modulo 2**64,
mixed with its length; a shingle's hash mixes those of its words in order. With fewer words than a shingle has, the
whole sequence is one shingle. Two different shingles share a 64-bit hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_TABLE = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     "))
_BYTE = np.random.default_rng(2718).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes of text that are hashed at a time; one longer text is hashed alone.
CHUNK = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _chunk_words(raw: list[bytes], pw: np.ndarray, inv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where those of each text begin and the last ends."""
    buf = np.frombuffer(b" ".join(raw).translate(_TABLE) + b" ", np.uint8)
    space = buf == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = np.concatenate([[0], edge]) if len(buf) and not space[0] else edge
    starts, ends = starts[0::2], starts[1::2]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pw[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * _M2)
    return h, np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))


def word_chunks(texts: list[str | bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts a chunk at a time, as _chunk_words has them."""
    raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    i = 0
    longest = max([len(r) + 1 for r in raw], default=1)
    size = max(CHUNK + longest, 2)
    pw, inv = _powers(_BASE, size + 1), _powers(_INVERSE, size + 1)
    while i < len(raw):
        j, n = i, 0
        while j < len(raw) and (j == i or n + len(raw[j]) + 1 <= CHUNK):
            n += len(raw[j]) + 1
            j += 1
        yield _chunk_words(raw[i:j], pw, inv)
        i = j


def word_hashes(texts: list[str | bytes | None]) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words in order."""
    for h, cuts in word_chunks(texts):
        for k in range(len(cuts) - 1):
            yield h[cuts[k] : cuts[k + 1]]


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text's word hashes, ascending; empty without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < size:
        h = np.uint64(len(words))
        with np.errstate(over="ignore"):
            for w in words:
                h = h * _M1 + w
        return mix(np.array([h], np.uint64))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _M1 + words[k : len(words) - size + 1 + k]
    return np.unique(mix(h))


def shingle_sets(texts: list[str | bytes | None], size: int, rank: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sets that shingles_of gives, a chunk of texts at a time: one after the other, where each begins and the last ends, and the words of each text.

    rank: a permutation of 2**k numbers, which takes the place of a shingle's first k bits; sets ascend in what that gives.
    """
    for h, cuts in word_chunks(texts):
        n = np.diff(cuts)
        ahead = np.append(h, np.zeros(size - 1, np.uint64))
        s = np.full(len(h), size, np.uint64)
        for k in range(size):
            s = s * _M1 + ahead[k : k + len(h)]
        s = mix(s)
        whole = np.ones(len(h), bool)  # shingles that end in the text in which they begin
        last = cuts[1:, None] - np.arange(1, size)
        whole[last[last >= cuts[:-1, None]]] = False
        for k in np.flatnonzero((n > 0) & (n < size)):
            s[cuts[k]] = shingles_of(h[cuts[k] : cuts[k + 1]], size)[0]
            whole[cuts[k]] = True
        s = s[whole]
        if rank is not None:
            low = np.uint64(64 - (len(rank) - 1).bit_length())
            s = (rank[(s >> low).astype(np.int64)].astype(np.uint64) << low) | (s & ((np.uint64(1) << low) - np.uint64(1)))
        begin = np.append(0, np.cumsum(np.where(n >= size, n - size + 1, np.minimum(n, 1))))
        for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            s[i:j].sort()
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        new[begin[:-1][begin[:-1] < len(s)]] = True
        yield s[new], np.append(0, np.cumsum(new))[begin], n
