"""Whole Arrow batches of texts as byte arrays: word spans, hashes and n-gram hashes.

Everything here works on UTF-8 bytes with numpy, over blocks of about a megabyte,
so memory follows the block (or the longest text), never the batch.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import xxhash

ODD = np.uint64(0xC2B2AE3D27D4EB4F)
#: Spans of up to so many bytes are hashed many at a time.
SHORT = 64
#: Masks of the first 0 to 8 of eight bytes.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of words that end at white space.
WORD = ~SPACE
#: Bytes of words made of ASCII digits and letters and of all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def store() -> types.SimpleNamespace:
    """What a worker process keeps from one task to the next."""
    return sys.modules.setdefault("_spanloom_store", types.SimpleNamespace())


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    return mix(a * ODD + b)


def uniq(x: np.ndarray) -> np.ndarray:
    """Sorted distinct entries (sorting is many times faster than numpy's hashed unique)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def seeds(salt: int) -> np.ndarray:
    """A start value for each length of a span up to SHORT bytes."""
    return mix(np.arange(SHORT + 1, dtype=np.uint64) + np.uint64((salt + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def blocks(texts: pa.Array, limit: int = BLOCK):
    """(first row, past the last row, bytes, offsets from 0) of successive rows; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs of bytes in a class within each text, and their first run by text (n + 1)."""
    m = inside[data]
    n = len(m)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = False, m[:-1], False, m[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    before[cut] = False
    after[cut - 1] = False
    start, end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(start, off, side="left")


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros past the end), as integers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand. Eight bytes at a
    time go through a mixing that is one to one in them; spans of over SHORT bytes are hashed by
    XXH64. No sum or polynomial: words of a regular make-up collide no more than others."""
    n = end - start
    at, first = lanes(data), seeds(salt)
    h = mix(first[np.minimum(n, SHORT)] ^ (at[start] & MASKS[np.minimum(n, 8)]))
    todo = np.flatnonzero((n > 8) & (n <= SHORT))
    for j in range(8, SHORT, 8):
        todo = todo[n[todo] > j]
        if not len(todo):
            break
        h[todo] = mix(h[todo] * ODD ^ (at[start[todo] + j] & MASKS[np.minimum(n[todo] - j, 8)]))
    for i in np.flatnonzero(n > SHORT):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], salt + 1)
    return h


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> bool:
    """Whether all spans a[a_at : a_at + n] equal b[b_at : b_at + n]; b has 8 bytes past its spans."""
    va, vb = lanes(a), np.ndarray((max(len(b) - 7, 0),), "<u8", b, 0, (1,))
    todo = np.flatnonzero(n <= SHORT)
    for j in range(0, SHORT, 8):
        todo = todo[n[todo] > j]
        if not len(todo):
            break
        mask = MASKS[np.minimum(n[todo] - j, 8)]
        if ((va[a_at[todo] + j] ^ vb[b_at[todo] + j]) & mask).any():
            return False
    return all(np.array_equal(a[a_at[i] : a_at[i] + n[i]], b[b_at[i] : b_at[i] + n[i]]) for i in np.flatnonzero(n > SHORT))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k successive entries of `words`, whatever text they are in: of spans of
    1, 2, 4, ... entries, then of the ones that make up k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, have = {1: words}, 1
    while have * 2 <= k:
        powers[have * 2] = pair(powers[have][:-have], powers[have][have:])
        have *= 2
    out, used = powers[have], have
    while used < k:
        have = 1 << ((k - used).bit_length() - 1)
        out = pair(out[:n], powers[have][used : used + n])
        used += have
    return out[:n]


def room(first: np.ndarray, total: int) -> np.ndarray:
    """For each word, how many words its text has from there on."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(total)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive entries."""
    n, have, out = len(x) - w + 1, 1, x
    if n <= 0:
        return x[:0]
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have : w - have + n]) if have < w else out[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, and nothing else."""
    return LOWER[data]


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one after the other."""
    n = hi - lo
    if not n.sum():
        return np.zeros(0, np.int64)
    out = np.ones(int(n.sum()), np.int64)
    lo, n = lo[n > 0], n[n > 0]
    at = np.cumsum(n)[:-1]
    out[0] = lo[0]
    out[at] = lo[1:] - (lo[:-1] + n[:-1] - 1)
    return np.cumsum(out)
