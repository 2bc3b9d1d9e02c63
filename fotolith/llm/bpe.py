"""BPE encoding and decoding by speculation and verification (operator 10).

Greedy longest match proposes the tokens of each distinct word. A proposal is the exact BPE result if
each of its tokens is what BPE makes of that token's own text, and no merge would cross the border
of any two neighbours. Both are checked for all words at once with numpy; only words that fail are
merged exactly, pair by pair.

Border check: undo the merges that made two neighbours, latest first. At each step the two symbols
at the border exist together until the earlier of the merges that use them up; a rule that joins
them and ranks before that would have crossed the border. Of equal ranks the left one goes first.

Null texts count as empty. Texts are split at ASCII white space first, which no token of the
vocabulary crosses, so that each distinct piece is encoded once per slice of rows.
"""

from __future__ import annotations

import ctypes
import gc
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.pieces import Pieces
from fotolith.llm.shared import bounded_batches

#: Rows of one slice hold about so many bytes of text.
SLICE_BYTES = 2 << 20
#: Words longer than this are merged with a heap.
LONG = 48
#: Words and pieces kept from slice to slice, about: once there are so many, no more are added.
MEMO, PIECES = 100_000, 300_000
NEVER = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: the byte's own
    character if printable, else the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Bpe:
    """One vocabulary file: its rules as arrays, and encoding of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.names = [""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for name, i in [*self.ids.items(), *self.specials.items()]:
            self.names[i] = name
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.symbols = str.maketrans({b: s for b, s in enumerate(byte_symbols())})
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        size = len(self.names)
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        rules, joined, self.rules = [], [], {}
        for k, (a, b) in enumerate(tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]):
            i, j, made = self.ids[a], self.ids[b], self.ids[a + b]
            rules.append((i * size + j, k))
            joined.append(made)
            self.rules[a, b] = k
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = k, i, j
        rules.sort()
        self.rule_made = np.array(joined, np.int64)
        self.size = size
        self.path, self.tokenizer = path, None
        self.memo: dict[str, list[int]] = {}
        self.kept = Pieces(self.encode_pieces, PIECES)
        self.strings = pa.array(self.names, pa.large_string())
        self.rule_codes = np.array([r[0] for r in rules], np.int64)
        self.rule_ranks = np.array([r[1] for r in rules], np.int64)
        self.inner = {t: i for t, i in self.ids.items() if not (self.suffix and t.endswith(self.suffix))}
        self.final = {t[: len(t) - len(self.suffix)]: i for t, i in self.ids.items() if t.endswith(self.suffix)} if self.suffix else self.inner
        self.longest = max([*map(len, self.inner), *map(len, self.final)])
        whole = np.array(sorted(self.ids.values()))
        made = whole[self.rank[whole] >= 0]
        self.sound = np.ones(size, bool)  # BPE makes this token of its own text
        self.sound[made] = ~self.crossed(self.left[made], self.right[made], skip_first=True)
        for i in made[np.argsort(self.rank[made])]:
            self.sound[i] &= self.sound[self.left[i]] and self.sound[self.right[i]]

    def rule_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.rule_codes, code), len(self.rule_codes) - 1)
        return np.where(self.rule_codes[at] == code, self.rule_ranks[at], NEVER)

    def crossed(self, a: np.ndarray, b: np.ndarray, skip_first: bool = False) -> np.ndarray:
        """For all neighbours a[i], b[i]: would a merge cross their border?"""
        out = np.zeros(len(a), bool)
        live, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        first = skip_first
        while len(live):
            hit = np.zeros(len(live), bool) if first else self.rule_rank(x, y) < np.minimum(until_x, until_y + 1)
            first = False
            out[live[hit]] = True
            rx, ry = self.rank[x], self.rank[y]
            go = ~hit & ((rx >= 0) | (ry >= 0))
            live, x, y, until_x, until_y, rx, ry = (v[go] for v in (live, x, y, until_x, until_y, rx, ry))
            undo = rx > ry
            until_x, x = np.where(undo, rx, until_x), np.where(undo, self.right[x], x)
            until_y, y = np.where(undo, until_y, ry), np.where(undo, y, self.left[y])
        return out

    def propose(self, word: str) -> list[int] | None:
        """Longest tokens from the left; None if a character has no token."""
        out, i, n, inner, longest = [], 0, len(word), self.inner, self.longest
        while n - i > longest or (t := self.final.get(word[i:])) is None:
            for j in range(min(i + longest, n - bool(self.suffix)), i, -1):
                if (t := inner.get(word[i:j])) is not None:
                    break
            else:
                return None
            out.append(t)
            i = j
            if i == n:
                return out
        out.append(t)
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging. Symbols without a token are left out, as there is no unknown token."""
        s = [*word[:-1], word[-1] + self.suffix]
        s = [t for t in s if t in self.ids]
        rules = self.rules
        if len(s) <= LONG:
            while len(s) > 1:
                best, at = min((rules.get(p, NEVER), k) for k, p in enumerate(zip(s, s[1:])))
                if best == NEVER:
                    break
                s[at : at + 2] = [s[at] + s[at + 1]]
            return [self.ids[t] for t in s]
        after, before = [*range(1, len(s)), -1], [*range(-1, len(s) - 1)]
        heap = [(r, k, s[k] + s[k + 1]) for k in range(len(s) - 1) if (r := rules.get((s[k], s[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, made = heapq.heappop(heap)
            if s[k] is None or (b := after[k]) < 0 or s[k] + s[b] != made or rules.get((s[k], s[b])) != r:
                continue
            s[k], s[b] = made, None
            after[k] = after[b]
            if after[b] >= 0:
                before[after[b]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j >= 0 and (r := rules.get((s[i], s[j]))) is not None:
                    heapq.heappush(heap, (r, i, s[i] + s[j]))
        return [self.ids[t] for t in s if t is not None]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """The ids of each word, and which words were merged exactly."""
        out = [self.propose(w) for w in words]
        n = np.array([len(t) if t else 0 for t in out], np.int64)
        flat = np.fromiter((i for t in out if t for i in t), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(words)), n)
        bad = n == 0
        bad[owner[~self.sound[flat]]] = True
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        bad[owner[pair[self.crossed(flat[pair], flat[pair + 1])]]] = True
        short = [k for k in np.flatnonzero(bad) if len(words[k]) <= LONG]
        for k, t in zip(short, self.merge_all([words[k] for k in short])):
            out[k] = t
        for k in np.flatnonzero(bad):
            if len(words[k]) > LONG:
                out[k] = self.merge(words[k])
        return out, bad

    def merge_all(self, words: list[str], rows: int = 20_000) -> list[list[int]]:
        """Exact merging of many short words at once: each round joins the lowest-ranked, leftmost
        pair of every word."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        out: list[list[int]] = [[] for _ in words]
        for start in range(0, len(order), rows):
            which = order[start : start + rows]
            symbols = [[i for t in (*w[:-1], w[-1] + self.suffix) if (i := self.ids.get(t)) is not None] for w in (words[k] for k in which)]
            width = max(1, max(map(len, symbols)))
            ids = np.array([s + [-1] * (width - len(s)) for s in symbols], np.int64)
            owner = np.arange(len(which))
            ranks = np.full((len(which), width), NEVER)
            a, b = ids[:, :-1], ids[:, 1:]
            ranks[:, :-1] = np.where((a >= 0) & (b >= 0), self.rule_rank(a, b), NEVER)
            while len(owner):
                at = ranks.argmin(axis=1)
                row = np.arange(len(owner))
                best = ranks[row, at]
                done = best == NEVER
                if done.any():
                    for k, s in zip(owner[done], ids[done].tolist()):
                        out[which[k]] = [i for i in s if i >= 0]
                    ids, ranks, owner, at, best = (v[~done] for v in (ids, ranks, owner, at, best))
                    if not len(owner):
                        break
                    row = np.arange(len(owner))
                ids[row, at] = self.rule_made[best]
                cols = np.arange(ids.shape[1] - 1)[None, :]
                ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
                ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
                for j in (at - 1, at):
                    ok = (j >= 0) & (j + 1 < ids.shape[1])
                    r, c = row[ok], j[ok]
                    a, b = ids[r, c], ids[r, c + 1]
                    ranks[r, c] = np.where((a >= 0) & (b >= 0), self.rule_rank(a, b), NEVER)
        return out

    def library(self):
        from tokenizers import Tokenizer

        if self.tokenizer is None:
            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer

    def split(self, piece: str) -> list[str | int]:
        """A text as words in the vocabulary's symbols and ids of special tokens."""
        if piece.isascii() and piece.isalpha():
            return [piece.lower() if self.lower else piece]
        out: list[str | int] = []
        for part in self.special_at.split(piece) if self.special_at else [piece]:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            if not part.isascii():
                if self.nfc:
                    part = unicodedata.normalize("NFC", part)
                if self.lower:
                    part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            elif self.lower:
                part = part.lower()
            if part.isascii() and part.isalpha():
                out.append(part)
            elif part.isascii() or not any(unicodedata.category(c) == "Cn" for c in part):
                out += [w.encode().decode("latin-1").translate(self.symbols) for w in self.pieces.findall(part)]
            else:  # unassigned here: its class depends on the tables' Unicode version, so the library that defines the result splits it
                out += [w for w, _ in self.library().pre_tokenizer.pre_tokenize_str(self.library().normalizer.normalize_str(part))]
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all pieces one after the other, how many each has); each distinct word is worked
        out once."""
        parts = [self.split(p) for p in pieces]
        words = list(dict.fromkeys(w for p in parts for w in p if isinstance(w, str)))
        fresh = [w for w in words if w not in self.memo]
        known = dict(zip(fresh, self.encode_words(fresh)[0]))
        if len(self.memo) < MEMO:
            self.memo |= {w: t for w, t in known.items() if len(w) <= LONG}
        known |= {w: self.memo[w] for w in words if w not in known}
        out = [known[p[0]] if len(p) == 1 and isinstance(p[0], str) else [i for w in p for i in (known[w] if isinstance(w, str) else [w])] for p in parts]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for t in out for i in t), np.uint32, int(sizes.sum())), sizes


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def forget() -> None:
    """For operators that a worker turns to after this one: what it kept of vocabularies goes."""
    if _loaded:
        _loaded.clear()
        gc.collect()  # they hold themselves
        give_back()


def give_back() -> None:
    """Free memory goes back to the system: workers stay for later tasks, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where the text column's bytes pass the limit; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))  # no offsets: some kernels get them wrong
    give_back()


def encode_column(bpe: Bpe, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(ids, decoded text) of each text."""
    flat, where = bpe.kept.column(texts)
    tokens = bpe.strings.take(pa.array(flat))
    decoded = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(where, pa.int64()), tokens), pa.scalar(" ", pa.large_string())) if len(flat) else pa.array([""] * len(texts), pa.large_string())
    return pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(flat.astype(np.int32))), decoded.cast(pa.string())


def bpe_round_trip(df: DataFrame, path: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the key, `ids` array<int> and `decoded` string (each id's token string, joined by one
    space, as a tokenizer without a decoder writes them, special tokens included). One narrow pass:
    no shuffle, memory bounded by a slice of rows. Null and empty texts: no ids, empty string. Rows
    are kept one for one, repeated ones too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part in slices(batches, "text"):
            ids, decoded = encode_column(bpe, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("key"), ids, decoded], ["key", "ids", "decoded"])

    bounded_batches(df)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`: the token strings of an id array joined by one space; null ids give null, ids
    outside the vocabulary are skipped."""

    @F.pandas_udf("string")
    def names(column):
        table = loaded(path).names
        return column.map(lambda v: None if v is None else " ".join(table[i] for i in v if 0 <= i < len(table)))

    return df.withColumn("decoded", names(F.col(ids)))
