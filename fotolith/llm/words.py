"""Vectorised word primitives shared by the operators that run Python on Arrow batches.

A word is a run of `[^\\x20\\x09-\\x0D]`; only A-Z are folded. Null and empty texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), wrapping around."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S33
    x *= _C1
    x ^= x >> _S33
    x *= _C2
    x ^= x >> _S33
    return x


def hash_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings data[offsets[i]:offsets[i + 1]], all at once.

    Each byte and its place in the string go through mix64 over a 16-bit table, and are summed; the
    length is mixed in last. Strings that differ in one byte or in order hash apart.
    """
    n = np.diff(offsets)
    if not len(n):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1] - offsets[0], n)
    each = mix64((data.astype(np.uint64) + np.uint64(1)) + (place.astype(np.uint64) << np.uint64(8)))
    sums = np.zeros(len(n) + 1, np.uint64)
    ends = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
    at = (offsets - offsets[0]).astype(np.int64)
    sums = ends[at[1:]] - ends[at[:-1]]
    return mix64(sums ^ (n.astype(np.uint64) * _C1))


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of an Arrow string array without nulls."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(strings) else np.zeros(0, np.uint8)
    return hash_bytes(data, offsets)


def split_words(texts: pa.Array | pa.ChunkedArray, fold: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes of all words in order, the distinct words, offsets of each text's words)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    keep = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(keep, min_count=0).as_py():
        mask = keep.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
        flat = flat.filter(keep)
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if fold:  # of the distinct words only; pyarrow's ascii_lower is wrong on some sliced arrays
        again = pc.ascii_lower(words).dictionary_encode()
        codes, words = again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], again.dictionary
    return codes, words, offsets


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside each text, and their offsets.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    n = np.diff(offsets)
    made = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(made)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    first = np.repeat(offsets[:-1], made) + np.arange(starts[-1]) - np.repeat(starts[:-1], made)
    room = np.repeat(offsets[1:], made) - first
    out = np.zeros(len(first), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        word = padded[first + k]
        if k:
            word = np.where(room > k, word, np.uint64(0))
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k + 1)) if k == width - 1 else out * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k + 1)
    return out, starts
