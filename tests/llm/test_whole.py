"""Operators do the whole of what they name: no count, pattern or row is left out."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from fotolith.llm import decontaminate, lm, pii

DATA = "/root/testdata/sf0.001"


def test_bigrams_seen_once_are_found():
    texts = [f"w{i} w{i + 1} w{i + 2}" for i in range(0, 6000, 2)]
    chunk = pa.table({"chunk": [0] * len(texts), "text": texts, "held_out": [i % 5 == 0 for i in range(len(texts))]})
    sent = lm._send(chunk, 2).to_pylist()
    made = [lm._add_up(pa.table({k: pa.array([r[k]], lm._SENT.field(k).type) for k in r}, schema=lm._SENT), 2) for r in sent]
    replies = pa.concat_tables(made)
    c = lm.Chunk(chunk)
    counts, words, pairs = lm._answers(c, replies.filter(pa.compute.greater_equal(replies["chunk"], 0)), 2)
    times = Counter(c.bigrams(np.flatnonzero(c.in_train)).tolist())
    exact = lm.level(np.array([times[k] for k in c.bigrams(np.arange(len(c.tokens))).tolist()]))
    assert (pairs >= exact).all() and (pairs[exact == 1] > 0).all() and (pairs == exact).mean() > 0.95
    assert (words >= lm.level(counts)).all() and (exact == 0).any()


def test_scores_are_those_of_all_counts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: [""] + [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) if w] + [""] for r in docs.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    words, pairs = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(words.values()), len(words)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs).collect()}
    coded = Counter((int(lm.level(words[a])) << 16) + (int(lm.level(pairs[a, b])) << 8) + int(lm.level(words[b])) for t in train for a, b in zip(t, t[1:]))
    weights = lm._weights(np.array([*coded]), np.array([*coded.values()]), n, v)
    off = []
    for i, t in texts.items():
        h, p, w = (lm.level(np.array(x)) for x in ([words[a] for a in t[:-1]], [pairs[a, b] for a, b in zip(t, t[1:])], [words[b] for b in t[1:]]))
        high, low = lm.shares(h, p, w, n, v, 0)
        off.append(abs(got[i] - np.log10(weights[h] * high + (1 - weights[h]) * low).sum()) / len(t))
    assert np.mean(off) < 0.02 and math.isfinite(sum(off)), np.mean(off)


def test_levels_without_tokens_have_a_weight():
    code = np.array([(6 << 16) + (5 << 8) + 6, (6 << 16) + 6])
    weights = lm._weights(code, np.array([80, 20]), 1000, 100)
    assert weights[0] == 0 and 0.5 < weights[9] < 0.9 and abs(weights[9] - weights[6]) < 0.05


def test_masks_miss_no_tolerated_pattern():
    for n in range(1, decontaminate.WINDOW + 1):
        spare = n - math.ceil(n * decontaminate.MATCHES / decontaminate.WINDOW)
        places = [{p + d for p in m} for m in decontaminate.masks(n) for d in range(n - m[-1])]
        for gone in itertools.chain(*(itertools.combinations(range(n), k) for k in range(spare + 1))):
            assert any(not p & {*gone} for p in places), (n, gone)


def test_every_tolerated_copy_is_found(spark):
    items, rows = [], []
    for n in range(1, 13):
        words = [f"t{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        width = min(n, 10)
        for k in range(width - math.ceil(width * 8 / 10) + 1):
            for gone in itertools.combinations(range(n), k):
                rows.append((len(rows), n, " ".join(["a", "b", *("zz" if p in gone else w for p, w in enumerate(words)), "c"])))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, n int, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.leaks(docs, benchmark).select("doc_id", "item_id").collect()}
    assert got == {(i, n) for i, n, _ in rows}


def test_the_fit_takes_all_lessons(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(pii, "fitted", lambda rows: taken.extend(rows) or (None, [math.inf] * 4))
    rows = [(i, "call +1 555 123 4567" if i % 3 else f"order {10_000_000 + i}") for i in range(30_000)]
    pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r[2] for r in taken) == 2 * 20_000 + 10_000 and len(taken) < 100
    assert {(r[1], r[3]) for r in taken} == {(a, b) for a in (True, False) for b in (True, False)}


def test_weights_are_copies():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (300, 12)).astype(float)
    y, times = (x[:, 1] + x[:, 4] > 5).astype(float), rng.integers(1, 9, 300)
    a, b = pii.Trees(x, y, times=times.astype(float)), pii.Trees(np.repeat(x, times, axis=0), np.repeat(y, times))
    assert np.allclose(a.values(x), b.values(x))
    some = rng.normal(size=300).round(1)
    assert pii.calibrated(some, y, 0.6, times) == pii.calibrated(np.repeat(some, times), np.repeat(y, times), 0.6)
