"""Words of whole texts as 64-bit hashes, taken from the bytes of an Arrow column.

Everything here works on a batch of texts at once with numpy: no loop over
texts, words or characters. A word is a maximal run of ASCII digits, ASCII
letters (lower-cased) and non-ASCII characters. In UTF-8 every byte of a
non-ASCII character is at least 0x80, so runs of bytes are runs of characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are worked on in pieces of about so many bytes, which bounds a task's memory.
CHUNK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_WORD_BYTE = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isdigit() or chr(_b).isalpha():
        _WORD_BYTE[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b
_powers = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    z = values ^ (values >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def give_back_memory() -> None:
    """Return freed memory to the system: Python workers stay alive between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def _power_table(base: int, n: int) -> np.ndarray:
    """1, base, base², ... modulo 2^64, at least ``n`` of them."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.cumprod(known)
    return known


def text_chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of consecutive texts and their offsets; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    del data, offsets, texts
    give_back_memory()


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values; no run crosses a text's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < n)]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[borders - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``codes[start:end]`` for every run; codes must not be 0 inside runs."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")), i + 1)
        low, high = starts[i], ends[j - 1]
        up, down = _power_table(BASE, high - low), _power_table(_INVERSE, high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(codes[low:high].astype(np.uint64) * up[: high - low], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return mix(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's words among them."""
    codes = _WORD_BYTE[data]
    starts, ends = _runs(codes > 0, offsets)
    return run_hashes(codes, starts, ends), np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of ``n`` consecutive words for every position that has them."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(size, n, np.uint64)
    for i in range(n):
        total *= np.uint64(BASE)
        total += words[i : i + size]
    return mix(total)


def room_after(word_offsets: np.ndarray) -> np.ndarray:
    """For every word, how many words its text has from it on."""
    counts = np.diff(word_offsets)
    ends = np.repeat(word_offsets[1:], counts)
    return ends - np.arange(word_offsets[-1])


def list_array(rows: np.ndarray, n_rows: int, values: pa.Array) -> pa.Array:
    """A list per row from values whose rows are in ascending order."""
    offsets = np.zeros(n_rows + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n_rows), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
