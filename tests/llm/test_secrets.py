"""Secrets: what the battery adds, its tails, and long texts."""

import math
import random
import time

import numpy as np

from fotolith.llm import secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WORDS = "the quick house information table window yesterday mountain river second after between carry orange simple garden letter".split()


def test_random_keys_are_added_and_words_are_not(spark):
    rng = random.Random(2)
    cases = []
    for i in range(1200):
        key = "".join(rng.choice(LETTERS if i % 2 else LETTERS.lower()) for _ in range(rng.choice((32, 40, 64))))
        name = rng.choice(("-", "_", "/")).join(rng.choice(WORDS) for _ in range(7))
        part = key if i % 4 == 0 else name if i % 4 == 1 else name + str(rng.randint(1, 99)) if i % 4 == 2 else ""
        lead = " ".join(rng.choice(WORDS) for _ in range(30)) + " "
        cases.append((lead + part + " end", i % 4 == 0, (len(lead), len(lead) + len(part))))
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.secret_spans(df).collect()}
    found = [span in got[i] for i, (_, key, span) in enumerate(cases) if key]
    wrong = [i for i, (_, key, _) in enumerate(cases) if not key and got[i]]
    assert sum(found) > 0.95 * len(found) and len(wrong) < 0.02 * len(found), (sum(found), len(found), len(wrong))


def test_tails_get_smaller_with_length():
    rng = random.Random(3)
    logs = [secrets.battery("".join(rng.choice(LETTERS) for _ in range(n)))[1] for n in (40, 150, 200, 400, 1000, 5000)]
    assert all(b < a < 0 for a, b in zip(logs, logs[1:])), logs
    assert math.isclose(math.exp(secrets._log_poisson_below(3, 5.0)), 0.26502591, rel_tol=1e-6) and math.isclose(math.exp(secrets._log_poisson_above(8, 5.0)), 0.13337167, rel_tol=1e-6)
    assert math.isclose(secrets._log_poisson_below(90, 100.0), math.log(0.17138), abs_tol=0.01) and abs(secrets._log_poisson_below(90, 1000.0) + 696.5) < 1


def test_the_law_is_measured(spark):
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(200)) for _ in range(40)]
    same, changes, alternation = secrets.law(sum(secrets.habits(pa.array([t])) for t in texts))
    joined = "".join(texts).replace(" ", "")
    share = np.array([joined.count(c) for c in "abcdefghijklmnopqrstuvwxyz"]) / len(joined)
    assert math.isclose(same, (share**2).sum(), rel_tol=1e-9) and changes == 1e-3 and -0.6 < alternation < 0
    assert secrets.law(np.zeros(31, np.int64)) == secrets.WRITTEN
    assert (secrets.habits(pa.array([], pa.string())) == 0).all()


def test_long_texts_take_seconds():
    rng = random.Random(5)
    blob = "".join(rng.choice(LETTERS) for _ in range(1_000_000))
    began = time.time()
    assert secrets.scan(blob)[1][0][:2] == (0, 1_000_000)
    assert len(secrets.scan("password=abcdef0123456789xyz " * 40_000)[0]) == 40_000
    assert time.time() - began < 30
