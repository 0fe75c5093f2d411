"""Words between blanks as 64-bit hashes, for whole Arrow columns of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BLANK = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
# A short word is hashed as a polynomial whose coefficients are random numbers of its bytes.
SPAN = 1 << 18
SHORT = 32
BASE = 0x9E3779B97F4A7C15
VALUES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], U64)
POWERS, INVERSES = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(SPAN + SHORT, r, U64)])) for r in (BASE, pow(BASE, -1, 1 << 64)))
# Stands for the end of a text.
END = U64(xxhash.xxh3_64_intdigest(b""))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    hashes = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = int(np.searchsorted(starts, low + SPAN))
        first, last = starts[at:stop] - low, np.minimum(ends[at:stop], starts[at:stop] + SHORT) - low
        sums = np.zeros(last[-1] + 1, U64)
        np.cumsum(VALUES[data[low : low + last[-1]]] * POWERS[: last[-1]], out=sums[1:])
        hashes[at:stop] = (sums[last] - sums[first]) * INVERSES[first]
        at = stop
    hashes = _mixed(hashes)
    for i in np.nonzero(ends - starts > SHORT)[0]:
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, small letters for ASCII, with ``END`` after each text, and the tokens of each text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, buffer = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer else np.zeros(0, np.uint8)
    data, bounds = LOWER[data], bounds - bounds[0]
    letter = ~BLANK[data]
    begins, closes = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    closes[:-1] &= ~letter[1:]
    # No word goes on into the next text.
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edge], closes[edge - 1] = letter[edge], letter[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    last = np.searchsorted(starts, bounds[1:]) + np.arange(len(texts))
    tokens, inner = np.full(len(starts) + len(texts), END, U64), np.ones(len(starts) + len(texts), dtype=bool)
    inner[last] = False
    tokens[inner] = _word_hashes(data, starts, ends)
    return tokens, np.diff(last, prepend=-1)
