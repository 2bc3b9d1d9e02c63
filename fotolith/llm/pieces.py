"""Ids of pieces of text between ASCII white space, kept by a worker from slice to slice."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fotolith.llm.words import split_words


class Pieces:
    """The ids of each distinct piece, worked out once as long as there is room for `most` pieces."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, listed: Callable[[pa.Array], list[str]] = pa.Array.to_pylist):
        """encode: (ids of all pieces one after the other, how many each has); listed: the strings of an array."""
        self.encode, self.most, self.listed = encode, most, listed
        self.known = pa.array([], pa.large_string())
        self.ids, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)  # piece k has starts[k] to starts[k + 1]

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        out = np.empty(max(size, len(array) * 3 // 2), array.dtype)
        out[: len(array)] = array
        return out

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece in `starts`, until the next call."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            names, base = pieces.take(pa.array(fresh)), len(self.known)
            ids, sizes = self.encode(self.listed(names))
            begin = int(self.starts[base])
            self.ids = self._room(self.ids, begin + len(ids))
            self.ids[begin : begin + len(ids)] = ids
            self.starts = self._room(self.starts, base + len(names) + 1)
            self.starts[base + 1 : base + len(names) + 1] = begin + np.cumsum(sizes)
            at[fresh] = base + np.arange(len(names))
            if base < self.most:
                self.known = pa.concat_arrays([self.known, names.slice(0, self.most - base)])
        return at

    def column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end); `end` closes each text."""
        codes, pieces, offsets = split_words(texts, fold=False)
        at = self.places(pieces.cast(pa.large_string()))
        first = self.starts[at]
        per = (self.starts[at + 1] - first)[codes]
        first = first[codes]
        ends = np.concatenate([[0], np.cumsum(per)])
        take = np.arange(ends[-1]) + np.repeat(first - ends[:-1], per)
        ids, where = self.ids[take], ends[offsets]
        if end is not None:
            ids, where = np.insert(ids, where[1:], end), where + np.arange(len(where))
        return ids, where
