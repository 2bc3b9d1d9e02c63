"""Token-ID files as wavelet matrices (operator 3).

Documents are dealt into ranges of doc_id; each range is encoded, and its ids are written as files
of one wavelet matrix each: a plane of bits per bit of the largest id, most significant first, every
plane holding that bit of all ids in the order that the planes above have dealt them (zeros before
ones), with counts of ones before each block of 512 bits for rank and select. A plane is compressed in
chunks, so that a single token is read from the counts and one chunk of each plane.

A file is one row of a Parquet table (`payload`) written by Spark's own committer, so that any store
that Spark writes to holds it, and a lost executor leaves nothing behind.

File layout, little-endian: 4 bytes magic, then int64 documents, tokens, planes; int64 doc_id of each
document and int64 tokens of each; for each plane int64 zeros and int64 chunks, int32 length of each
chunk, uint32 ones before each block and in all, and the chunks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolith.llm.bpe import byte_symbols, give_back, slices
from fotolith.llm.pieces import Pieces
from fotolith.llm.shared import bounded_batches, new_path, text_bytes
from fotolith.llm.words import split_words

MAGIC = b"WMX2"
#: Bits of a block, which has a count, and of a chunk, which is compressed alone.
BLOCK, CHUNK = 512, 1 << 16
#: A file is closed once it has so many tokens; a document is never split.
FILE_TOKENS = 1 << 21
#: Bytes of text a range of documents holds, about.
RANGE_BYTES = 16 << 20
#: Bytes of text whose distinct pieces are encoded together, about: a range's as a rule; and bytes of
#: distinct pieces that are encoded at once.
GATHERED_BYTES, PIECE_BYTES = 24 << 20, 6 << 20
#: Words whose ids a worker keeps, about.
WORDS = 600_000


class Dealt(NamedTuple):
    """Places in a chunk, and where the ids at them go, in order."""

    places: np.ndarray
    to: slice


def dealing(one: np.ndarray, zeros: int) -> Iterator[tuple[int, Dealt, Dealt]]:
    """Where a plane's bits deal the ids, chunk by chunk so that all stays in the processor's cache:
    the chunk's first place, its zeros and its ones. Places take no branch for each id, unlike masks."""
    low, high = 0, zeros
    for at in range(0, len(one), CHUNK):
        bits = one[at : at + CHUNK]
        a, b = np.flatnonzero(~bits), np.flatnonzero(bits)
        yield at, Dealt(a, slice(low, low + len(a))), Dealt(b, slice(high, high + len(b)))
        low, high = low + len(a), high + len(b)


class WaveletMatrix:
    """Ids with access, count (rank) and lookup of occurrences (select), from compressed planes."""

    def __init__(self, size: int, zeros: list[int], planes: list[list[bytes]], before: list[np.ndarray]):
        self.size, self.zeros, self.packed, self.before = size, zeros, planes, before
        self.open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.ascontiguousarray(ids)
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        if bits <= 16:
            ids = ids.astype(np.uint16)
        size, zip_, zeros, planes, before = len(ids), zstandard.ZstdCompressor(level=1), [], [], []
        for k in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << k)) != 0
            packed = np.packbits(one, bitorder="little")
            planes.append([zip_.compress(packed[a : a + CHUNK // 8].tobytes()) for a in range(0, len(packed), CHUNK // 8)])
            whole = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)]).reshape(-1, BLOCK // 8)
            before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(whole).sum(axis=1, dtype=np.int64))]).astype("<u4"))
            zeros.append(size - int(before[-1][-1]))
            out = np.empty_like(ids)
            for at, low, high in dealing(one, zeros[-1]):
                ids[at : at + CHUNK].take(low.places, out=out[low.to], mode="clip")
                ids[at : at + CHUNK].take(high.places, out=out[high.to], mode="clip")
            ids = out
        return cls(size, zeros, planes, before)

    def block(self, k: int, b: int) -> np.ndarray:
        """The bits of a block of plane k; its chunk is unpacked when first asked for."""
        c = b // (CHUNK // BLOCK)
        if (k, c) not in self.open:
            packed = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed[k][c]), np.uint8)
            self.open[k, c] = np.unpackbits(packed, count=min(CHUNK, self.size - c * CHUNK), bitorder="little")
        at = b * BLOCK - c * CHUNK
        return self.open[k, c][at : at + BLOCK]

    def ones(self, k: int, i: int) -> int:
        rest = i % BLOCK
        return int(self.before[k][i // BLOCK]) + (int(self.block(k, i // BLOCK)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        out = 0
        for k in range(len(self.packed)):
            one = int(self.block(k, i // BLOCK)[i % BLOCK])
            out = out << 1 | one
            i = self.zeros[k] + self.ones(k, i) if one else i - self.ones(k, i)
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where occurrences of a token before place i lie in the last plane's order."""
        a, b = 0, i
        if token >> len(self.packed):
            return 0, 0
        for k in range(len(self.packed)):
            x, y = self.ones(k, a), self.ones(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if token >> (len(self.packed) - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, i: int | None = None) -> int:
        """Occurrences of a token before place i (everywhere, if not given)."""
        a, b = self._range(token, self.size if i is None else i)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """The place of the nth occurrence (from 0) of a token."""
        a, b = self._range(token, self.size)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        at = a + nth
        for k in range(len(self.packed) - 1, -1, -1):
            one = token >> (len(self.packed) - 1 - k) & 1
            want = at - self.zeros[k] if one else at
            at = self._select_bit(k, one, want)
        return at

    def _select_bit(self, k: int, one: int, nth: int) -> int:
        before = self.before[k].astype(np.int64)
        marks = before if one else np.minimum(np.arange(len(before)) * BLOCK, self.size) - before
        b = int(np.searchsorted(marks, nth, side="right")) - 1
        return b * BLOCK + int(np.flatnonzero(self.block(k, b) == one)[nth - int(marks[b])])

    def all(self) -> np.ndarray:
        """Every id in order: the planes' dealing undone from the last to the first."""
        wide = np.uint16 if len(self.packed) <= 16 else np.uint32
        out = np.zeros(self.size, wide)
        for k in range(len(self.packed) - 1, -1, -1):
            packed = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(c) for c in self.packed[k]), np.uint8)
            one = np.unpackbits(packed, count=self.size, bitorder="little").view(bool)
            above = np.empty(self.size, wide)
            out[self.zeros[k] :] |= wide(1 << (len(self.packed) - 1 - k))
            for at, low, high in dealing(one, self.zeros[k]):
                above[at : at + CHUNK][low.places] = out[low.to]
                above[at : at + CHUNK][high.places] = out[high.to]
            out = above
        return out


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    w = WaveletMatrix.build(ids)
    head = [MAGIC, struct.pack("<qqq", len(doc_ids), len(ids), len(w.packed)), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<i8").tobytes()]
    planes = ((struct.pack("<qq", z, len(p)), np.array([len(c) for c in p], "<i4").tobytes(), b.tobytes(), *p) for z, p, b in zip(w.zeros, w.packed, w.before))
    return b"".join(head + [x for plane in planes for x in plane])


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc_id, tokens) of each document, and the ids."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, size, planes = struct.unpack_from("<qqq", payload, 4)
    at = 28
    doc_ids, lengths = np.frombuffer(payload, "<i8", docs, at), np.frombuffer(payload, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    zeros, packed, before = [], [], []
    for _ in range(planes):
        z, chunks = struct.unpack_from("<qq", payload, at)
        ends = at + 16 + 4 * chunks + 4 * (-(-size // BLOCK) + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(payload, "<i4", chunks, at + 16), dtype=np.int64)])
        zeros.append(z)
        before.append(np.frombuffer(payload, "<u4", -(-size // BLOCK) + 1, at + 16 + 4 * chunks))
        packed.append([payload[a:b] for a, b in zip(ends[:-1], ends[1:])])
        at = int(ends[-1])
    return doc_ids, lengths, WaveletMatrix(size, zeros, packed, before)


def spread(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places first[k], first[k] + 1 and so on of runs of sizes[k], one run after the other; where
    each run begins and ends among them)."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    kind = np.int32 if max(ends[-1], first.max(initial=0) + sizes.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((first - ends[:-1]).astype(kind), sizes)
    out += np.arange(ends[-1], dtype=kind)
    return out, ends


def listed(strings: pa.Array) -> list[str]:
    """As to_pylist, which makes an object of its own for each string first."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Encodes columns of texts with the tokenizers library, each distinct word of the pieces between
    ASCII white space once: no token of a vocabulary that drops white space crosses it."""

    #: Letters whose normal form, case and class don't depend on anything around them, and marks.
    LETTERS = "".join(c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]) if c not in "×÷")
    MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
    #: A piece of one word and perhaps one run of marks after it.
    SIMPLE = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{re.escape(MARKS)}]*$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.codes = np.array([*map(ord, byte_symbols())], "<u2")
        self.codes[0x20] = 0x20  # between words
        #: the vocabulary folds case, takes letters and marks apart, and no special token is made of them alone, so that SIMPLE holds
        self.plain = self.library.normalizer is not None and not any(re.fullmatch(f"[{self.LETTERS}]*[{re.escape(self.MARKS)}]*", t) for t in self.specials) and self.words(
            f"Aqz,. {self.LETTERS}{self.MARKS} Z;"
        ) == ["aqz", ",.", *self.in_symbols(pa.array([self.LETTERS.lower()], pa.large_string())).to_pylist(), self.MARKS, "z", ";"]
        self.kept = Pieces(self.encode_all, WORDS, listed)

    def words(self, piece: str) -> list[str]:
        """The library's words of a piece; the piece after a space if a special token's string is in it."""
        for t in self.specials:
            if t in piece:
                return [" " + piece]
        if self.library.normalizer is not None:
            piece = self.library.normalizer.normalize_str(piece)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def in_symbols(self, words: pa.Array) -> pa.Array:
        """Words without white space, each byte as its character in the vocabulary."""
        if pc.all(pc.string_is_ascii(words), min_count=0).as_py():
            return words
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(" ", pa.large_string()))
        text = self.codes[np.frombuffer(joined[0].as_buffer(), np.uint8)].tobytes().decode("utf-16-le")
        return pc.split_pattern(pa.array([text], pa.large_string()), " ").flatten()

    def split(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(the distinct words of pieces, the numbers of each piece's words among them, how many words
        each piece has). Only pieces that are not SIMPLE are taken apart by the library, one by one."""
        simple = pc.match_substring_regex(pieces, self.SIMPLE).to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(pieces), bool)
        some = pieces.filter(pa.array(simple))
        stems, marks = self.in_symbols(pc.utf8_lower(pc.ascii_rtrim(some, self.MARKS))), pc.utf8_ltrim(some, self.LETTERS)
        marked = pc.not_equal(pc.binary_length(marks), 0).to_numpy(zero_copy_only=False)
        rest = [self.words(p) for p in listed(pieces.filter(pa.array(~simple)))]
        coded = pa.concat_arrays([stems, marks.filter(pa.array(marked)), pa.array([w for p in rest for w in p], pa.large_string())]).dictionary_encode()
        numbers, sizes = np.empty(len(coded), np.int64), np.ones(len(pieces), np.int64)
        sizes[simple] += marked
        sizes[~simple] = np.fromiter(map(len, rest), np.int64, len(rest))
        begins = np.cumsum(sizes) - sizes
        numbers[np.concatenate([begins[simple], begins[simple][marked] + 1, spread(begins[~simple], sizes[~simple])[0]])] = coded.indices.to_numpy(zero_copy_only=False)
        return coded.dictionary, numbers, sizes

    def encode_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words one after the other, how many each has)."""
        tokenize = self.library.model.tokenize
        out = [self.library.encode(w[1:], add_special_tokens=False).ids if w[:1] == " " else [t.id for t in tokenize(w)] for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(sizes.sum())), sizes

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all pieces one after the other, how many each has)."""
        words, numbers, sizes = self.split(pieces)
        at = self.kept.places(words)
        first, per = self.kept.starts[at], self.kept.starts[at + 1] - self.kept.starts[at]
        take, ends = spread(first[numbers], per[numbers])
        return self.kept.ids[take], np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])

    def columns(self, columns: list[pa.Array], end: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts, ids of each) of each column, each text closed by `end`. The distinct pieces
        of all columns are encoded together, in blocks of some MB; texts are put together column by column."""
        cut = []
        for texts in columns:
            codes, pieces, offsets = split_words(texts, fold=False)
            cut.append((codes.astype(np.int32), pieces.cast(pa.large_string()), offsets))
        coded = pa.concat_arrays([pieces for _, pieces, _ in cut]).dictionary_encode()
        indices, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        size = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // PIECE_BYTES)) + 1
        made = [self.encode_pieces(pieces.slice(a, b - a)) for a, b in zip([0, *cuts], [*cuts, len(pieces)])]
        known, sizes = np.concatenate([ids for ids, _ in made]), np.concatenate([n for _, n in made])
        starts, begin = np.cumsum(sizes) - sizes, 0
        for codes, pieces, offsets in cut:
            places = indices[begin : begin + len(pieces)]
            begin += len(pieces)
            take, ends = spread(starts[places][codes], sizes[places][codes])
            ids, where = known[take], ends[offsets]
            if end is not None:
                ids, where = np.insert(ids, where[1:], end), where + np.arange(len(where))
            yield ids, np.diff(where)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches whose texts have at most about `limit` bytes together, or one batch."""
    held, size = [], 0
    for batch in batches:
        more = pc.sum(pc.binary_length(batch.column(column)), min_count=0).as_py()
        if held and size + more > limit:
            yield held
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield held


_encoders: dict[str, Encoder] = {}


def write_token_files(df: DataFrame, path: str, vocabulary: str, end: int | None = 2, column: str = "text", key: str = "doc_id", range_bytes: int = RANGE_BYTES) -> None:
    """Encode every whole text and write the ids at `path` in ascending order of the key.

    One range shuffle of the texts, sized by their bytes; ranges hold no key of another one, and a
    task keeps one file's ids at a time. Rows: shard (range), part (file in it), docs, n_tokens,
    payload. Null and empty texts have no ids but the end. Repeated keys stay, in order of their
    texts. Rows whose key is null are left out: there is no place for them in the order.
    """
    bounded_batches(df)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(column), F.lit("")).alias("text")).where("key is not null")
    ranges = max(1, -(-text_bytes(rows) // range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        encoder = _encoders[vocabulary]
        shard, part = TaskContext.get().partitionId(), 0
        keys, sizes, ids, held = [], [], [], 0

        def close():
            payload = pack(np.concatenate(keys), np.concatenate(sizes), np.concatenate(ids))
            return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "docs": [sum(map(len, keys))], "n_tokens": [held], "payload": [payload]}, schema=schema)

        for some in gathered(slices(batches, "text", 4 << 20), "text", GATHERED_BYTES):
            for batch, (flat, n) in zip(some, encoder.columns([b.column("text") for b in some], end)):
                keys.append(batch.column("key").to_numpy(zero_copy_only=False))
                sizes.append(n)
                ids.append(flat)
                held += len(flat)
                if held >= FILE_TOKENS:
                    yield close()
                    keys, sizes, ids, held, part = [], [], [], 0, part + 1
        if keys:
            yield close()
        give_back()

    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    dealt = rows.repartitionByRange(ranges, "key").sortWithinPartitions("key", "text")
    dealt.mapInArrow(run, "shard int, part int, docs long, n_tokens long, payload binary").write.option("compression", "uncompressed").parquet(path)


def read_documents(spark, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files at `path`: key, start (ids of all documents before it), n_tokens and
    ids_crc32, the checksum of its ids as little-endian unsigned 32-bit integers.

    The files' sizes, one small row a file, are summed in order; everything else is per file.
    """
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, payload in zip(*(batch.column(c) for c in ("shard", "part", "payload"))):
                doc_ids, lengths, matrix = unpack(payload.as_py())
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends - lengths, ends)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array([shard.as_py()] * n, pa.int32()), pa.array([part.as_py()] * n, pa.int32()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], ["key", "shard", "part", "at", "n_tokens", "ids_crc32"])

    docs = files.select("shard", "part", "payload").mapInArrow(run, "key long, shard int, part int, at long, n_tokens long, ids_crc32 long")
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("shard", "part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    return docs.join(before, ["shard", "part"]).select(F.col("key").alias(key), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(df: DataFrame, vocabulary: str, end: int | None = 2) -> DataFrame:
    """Write the files in the shared folder and read the documents back from them."""
    path = new_path(df.sparkSession, "token-files")
    write_token_files(df, path, vocabulary, end)
    return read_documents(df.sparkSession, path)
