"""LM scoring with a log-frequency Bloom filter (operator 2).

Documents are dealt into chunks by their key. A chunk sends its distinct words with their training
counts to the words' owners (a bucket of the hash space), which add them up and answer each chunk
with the totals in the order asked; and it sends hashes of its bigrams with their training counts.
Chunks and owners exchange compressed blocks, never a row a token.

The filter holds, for an n-gram of quantised count level q, the members (n-gram, 1) to (n-gram, q);
its level is found again by probing one after the other until a probe fails. Every owner builds the
part of its bucket, sized by its own members, and answers each chunk's probes from it. Nothing is
broadcast, so no level is left out, and a part is as large as its bucket, not as the corpus.

Probabilities are Jelinek and Mercer's: a bigram share of the history's count and a unigram share,
weighted by the history's count level; the weights come from expectation-maximisation over all
training tokens, summed by their levels, each token left out of its own counts.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.shared import bounded_batches, text_bytes, written
from fotolith.llm.words import hash_strings, mix64, split_words

#: Bytes of text in a chunk and behind an owner, about, and the least number of either.
CHUNK_BYTES, OWNER_BYTES, CHUNKS, OWNERS = 8 << 20, 32 << 20, 64, 16
#: Bits a member; probes a member.
BITS, PROBES = 10, 5
#: Base of the count levels, and their number.
BASE, LEVELS = 1.5, 64
#: Rounds of the fit, and the tokens that its prior counts as.
FIT_ROUNDS, PRIOR = 20, 1.0
KEY_BITS = 48
_EDGES = np.array(sorted({math.ceil(BASE**k) for k in range(LEVELS + 8)}), np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """0 for a count of 0, else the number of edges 1, 2, 3, 4, 6, ... reached."""
    return np.searchsorted(_EDGES, counts, side="right")


#: The count that stands for a level: the geometric mean of its least and largest.
VALUE = np.concatenate([[0.0], np.sqrt(_EDGES[:-1].astype(float) * (_EDGES[1:] - 1))])


def squeeze(values: np.ndarray, width: int = 8) -> bytes:
    """Integers below 2**(8 * width), byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T[:width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def bundle(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def unbundle(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", data)
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}q", data, 8):
        out.append(data[at : at + size])
        at += size
    return out


class Chunk:
    """The tokens of a chunk: words in sorted order, so that they are the same whenever it is read;
    the last token of each text is the end, whose word is empty."""

    def __init__(self, table: pa.Table):
        codes, words, offsets = split_words(table.column("text"))
        order = pc.sort_indices(words).to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words = pa.concat_arrays([pa.array([""], pa.large_string()), words.take(pa.array(order)).cast(pa.large_string())])
        n = np.diff(offsets)
        self.tokens = np.insert(place[codes] + 1, offsets[1:], 0)
        self.offsets = np.concatenate([[0], np.cumsum(n + 1)])
        self.before = np.concatenate([[0], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        self.train = ~np.asarray(table.column("held_out").to_numpy(zero_copy_only=False), bool)
        self.in_train = np.repeat(self.train, n + 1)
        self.hash = hash_strings(self.words)

    def bigrams(self, which: np.ndarray) -> np.ndarray:
        return mix64(self.hash[self.before[which]] * np.uint64(0x9E3779B97F4A7C15) + self.hash[self.tokens[which]]) >> np.uint64(64 - KEY_BITS)


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    return (keys % np.uint64(owners)).astype(np.int64)


class Filter:
    """Parts of one bit array: part p holds places base[p] to base[p] + size[p]."""

    def __init__(self, data: bytes, base: np.ndarray, size: np.ndarray, owners: int, least: tuple[int, int] = (1, 1)):
        self.bits, self.base, self.size, self.owners, self.least = np.frombuffer(data, np.uint8), base, size, owners, least

    @staticmethod
    def places(keys: np.ndarray, levels: np.ndarray | int, size: np.ndarray | int, probe: int) -> np.ndarray:
        h = mix64(keys * np.uint64(LEVELS * 2) + np.asarray(levels, np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B1) + np.uint64(probe) * step * np.uint64(0x85EBCA77)) % np.asarray(size, np.uint64)

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        """The level of each key: members probed upwards until one is missing. Levels below the
        least one kept hold no key, so that a chain that ends there is taken as absent."""
        part = owner_of(keys, self.owners) + order * self.owners
        base, size = self.base[part], self.size[part]
        out = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(size > 0)
        for q in range(1, LEVELS):
            for p in range(PROBES):
                at = base[live] + self.places(keys[live], q, size[live], p).astype(np.int64)
                live = live[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                if not len(live):
                    break
            out[live] = q
            if not len(live):
                break
        out[out < self.least[order]] = 0
        return out


def _send(table: pa.Table, owners: int) -> pa.Table:
    """A chunk's words and bigrams, to their owners."""
    if not table.num_rows:
        return pa.table({"chunk": [], "owner": [], "payload": []}, schema=_SENT)
    chunk, c = table.column("chunk")[0].as_py(), Chunk(table)
    counts = np.bincount(c.tokens[c.in_train], minlength=len(c.words))
    own, rows = owner_of(c.hash >> np.uint64(64 - KEY_BITS), owners), []
    for o in range(owners):
        mine = np.flatnonzero(own == o)
        if len(mine):
            words = c.words.take(pa.array(mine))
            text = zstandard.ZstdCompressor(level=1).compress(pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar("\n", pa.large_string()))[0].as_py().encode())
            rows.append((chunk, o, bundle(text, squeeze(counts[mine]))))
    keys, at = np.unique(c.bigrams(np.arange(len(c.tokens))), return_inverse=True)
    times = np.bincount(at.ravel()[c.in_train], minlength=len(keys))
    own = owner_of(keys, owners)
    for o in range(owners):
        mine = own == o
        if mine.any():
            k = keys[mine]
            rows.append((chunk, owners + o, bundle(squeeze(np.diff(k, prepend=np.uint64(0)), KEY_BITS // 8), squeeze(times[mine]))))
    return pa.table({"chunk": [r[0] for r in rows], "owner": [r[1] for r in rows], "payload": [r[2] for r in rows]}, schema=_SENT)


_SENT = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("payload", pa.binary())])
_OWNED = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("payload", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def _add_up(table: pa.Table, owners: int) -> pa.Table:
    """An owner's answers to the chunks (chunk >= 0): its words' totals and levels, or its bigrams'
    levels, in the order asked; and its words' totals (chunk -1). Levels come from its filter part."""
    owner = table.column("owner")[0].as_py()
    chunks, parts = table.column("chunk").to_pylist(), [unbundle(p) for p in table.column("payload").to_pylist()]
    times = [unsqueeze(p[1]) for p in parts]
    if owner < owners:
        words = pa.concat_arrays([pc.split_pattern(pa.array([zstandard.ZstdDecompressor().decompress(p[0]).decode()], pa.large_string()), "\n").flatten() for p in parts]).dictionary_encode()
        where = words.indices.to_numpy().astype(np.int64)
        keys = hash_strings(words.dictionary) >> np.uint64(64 - KEY_BITS)
    else:
        keys, where = np.unique(np.concatenate([np.cumsum(unsqueeze(p[0], KEY_BITS // 8), dtype=np.uint64) for p in parts]), return_inverse=True)
        where = where.ravel()
    total = np.bincount(where, np.concatenate(times).astype(float), len(keys)).astype(np.int64)
    order, exact = np.argsort(keys, kind="stable"), level(total)
    bits = _build(bundle(squeeze(np.diff(keys[order], prepend=np.uint64(0)), KEY_BITS // 8), squeeze(exact[order], 1)), 1)
    found = Filter(bits, np.zeros(1, np.int64), np.full(1, 8 * len(bits)), 1).levels(keys, 0)
    rows, at = [], 0
    for chunk, t in zip(chunks, times):
        asked = where[at : at + len(t)]
        rows.append((chunk, owner, bundle(squeeze(found[asked], 1), squeeze(total[asked])) if owner < owners else bundle(squeeze(found[asked], 1)), None, None))
        at += len(t)
    if owner < owners:
        rows.append((-1, owner, None, int(total.sum()), int((total > 0).sum())))
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OWNED)}, schema=_OWNED)


def _build(payload: bytes, least: int) -> bytes:
    """An owner's part of the filter."""
    deltas, levels = unbundle(payload)
    keys, levels = np.cumsum(unsqueeze(deltas, KEY_BITS // 8), dtype=np.uint64), unsqueeze(levels, 1).astype(np.int64)
    keys, levels = keys[levels >= least], levels[levels >= least]
    size = -(-int(levels.sum()) * BITS // 8) * 8
    if not size:
        return b""
    bits = np.zeros(size, bool)
    for q in range(1, int(levels.max()) + 1):
        some = keys[levels >= q]
        for p in range(PROBES):
            bits[Filter.places(some, q, size, p).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def shares(history: np.ndarray, pair: np.ndarray, word: np.ndarray, n: int, v: int, left_out: int) -> tuple[np.ndarray, np.ndarray]:
    """(bigram share, unigram share) of tokens by the levels of history, bigram and word; left_out is
    taken off each count."""
    history, pair, word = VALUE[history], VALUE[pair], VALUE[word]
    pair = np.minimum(pair, np.minimum(history, word))
    share = np.maximum(pair - left_out, 0) / np.maximum(history - left_out, 1)
    return np.minimum(share, 1), (np.maximum(word - left_out, 0) + 1) / (n + v + 1)


def _answers(c: Chunk, replies: pa.Table, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the owners' answers: exact training counts and levels of the chunk's words, and the levels
    of its tokens' bigrams."""
    keys, at = np.unique(c.bigrams(np.arange(len(c.tokens))), return_inverse=True)
    own, owned = owner_of(c.hash >> np.uint64(64 - KEY_BITS), owners), owner_of(keys, owners)
    counts, words, pairs = np.zeros(len(c.words), np.int64), np.zeros(len(c.words), np.uint8), np.zeros(len(keys), np.uint8)
    for o, payload in zip(replies.column("owner").to_pylist(), replies.column("payload").to_pylist()):
        found = unbundle(payload)
        if o < owners:
            words[own == o], counts[own == o] = unsqueeze(found[0], 1), unsqueeze(found[1])
        else:
            pairs[owned == o - owners] = unsqueeze(found[0], 1)
    return counts, words, pairs[at.ravel()]


def _levels(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels of history, bigram and word of the tokens of rows, and where each row begins. A text's
    first token follows an end, as any row's last token is."""
    data = column.to_pylist()
    both = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 2)
    word = both[:, 0].astype(np.int64)
    return np.roll(word, 1), both[:, 1].astype(np.int64), word, np.cumsum([0] + [len(d) // 2 for d in data])[:-1]


def score_texts(df: DataFrame, column: str = "text", key: str = "doc_id", folds: int = 7, held: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Trained on rows whose crc32(key as text) mod `folds` is not `held` (a null key counts as
    training). Null and empty texts are one end token. With no training text at all every
    probability is 1 / (0 + 0 + 1), and scores are 0. Rows are kept one for one. Texts are shuffled
    by chunk twice (to count and to look up); a worker holds one chunk or one owner's blocks. Two
    levels a token are written to the shared folder, for the fit and the scores.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(column), F.lit("")).alias("text"), F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(False)).alias("held_out"))
    bounded_batches(rows)
    size = text_bytes(rows)
    chunks, owners = max(CHUNKS, -(-size // CHUNK_BYTES)), max(OWNERS, -(-size // OWNER_BYTES))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))
    sent = rows.groupBy("chunk").applyInArrow(lambda t: _send(t, owners), "chunk long, owner int, payload binary")
    owned = written(sent.groupBy("owner").applyInArrow(lambda t: _add_up(t, owners), "chunk long, owner int, payload binary, n long, v long"), "lm-counts")
    n, v = (x or 0 for x in owned.where("chunk = -1").agg(F.sum("n"), F.sum("v")).first())

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left)
        counts, words, pairs = _answers(c, right, owners)
        add = lambda x: np.add.reduceat(x, c.offsets[:-1]) if len(c.offsets) > 1 else np.zeros(0)
        base = np.log10((counts + 1) / (n + v + 1))[c.tokens]
        both = np.stack([words[c.tokens], pairs], axis=1).tobytes()
        levels = pa.array([both[2 * a : 2 * b] for a, b in zip(c.offsets[:-1], c.offsets[1:])], pa.binary())
        return pa.table([left.column("key"), left.column("held_out"), pa.array(np.diff(c.offsets)), pa.array(add((counts > 0)[c.tokens].astype(np.int64))), pa.array(add(base)), levels], ["key", "held_out", "n_tokens", "n_known", "base_score", "levels"])

    kind = df.schema[key].dataType.simpleString()
    replies = owned.where("chunk >= 0").select("chunk", "owner", "payload")
    found = rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(look_up, f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, levels binary")
    found = written(found, "lm-levels")
    weights = _fit(found, n, v)

    def score(batches):
        for b in batches:
            if b.num_rows:
                history, pair, word, starts = _levels(b.column("levels"))
                high, low = shares(history, pair, word, n, v, 0)
                w = weights[history]
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("key", "held_out", "n_tokens", "n_known")), pa.array(np.full(b.num_rows, n, np.int64)), b.column("base_score"), pa.array(np.add.reduceat(np.log10(w * high + (1 - w) * low), starts))], ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return found.mapInArrow(score, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)


def _fit(found: DataFrame, n: int, v: int) -> np.ndarray:
    """Weights of the bigram share by the history's level, fitted on the training texts' counts of
    (history, bigram, word) levels, a table whose size the levels bound."""

    def seen(batches):
        for b in batches:
            if b.num_rows:
                history, pair, word, _ = _levels(b.column("levels"))
                code, times = np.unique((history << 16) + (pair << 8) + word, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], ["code", "times"])

    got = found.where("not held_out").select("levels").mapInArrow(seen, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).collect()
    return _weights(np.array([r["code"] for r in got], np.int64), np.array([r["times"] for r in got], np.int64), n, v)


def _weights(code: np.ndarray, times: np.ndarray, n: int, v: int) -> np.ndarray:
    at = code >> 16
    high, low = shares(at, code >> 8 & 255, code & 255, n, v, 1)
    w, total = np.full(LEVELS + 8, 0.5), np.bincount(at, times, LEVELS + 8)
    for _ in range(FIT_ROUNDS):
        a = w[at] * high
        bigram = np.bincount(at, times * a / (a + (1 - w[at]) * low), LEVELS + 8)
        every = bigram.sum() / max(total.sum(), 1)  # a level without tokens takes the weight of all
        w = (bigram + PRIOR * every) / (total + PRIOR)
    w[0] = 0.0
    return np.clip(w, 0, 0.999)
