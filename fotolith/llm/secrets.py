"""Secret scans by a battery of randomness tests (operator 6).

Three patterns give the base spans. The method adds runs of encoded characters that look drawn at
random from an inferred alphabet (hex, base32, alphanumeric, base64). The battery has a chi-squared
test of uniformity over that alphabet, a runs test over character classes, and a serial-correlation
test of neighbours as vowels or not. Each test gives two p-values: under "drawn at random", which must
not be rejected, and under "written text", whose law (how often two letters are equal, the class
changes and a vowel follows a vowel) is measured on all texts. The chi-squared statistic counts equal
pairs; under written text their number is Poisson's, and its lower tail is the test's second p-value.
The three second p-values are joined by Fisher's method. Discoveries among them are chosen by Benjamini
and Hochberg's step-up rule in each class of lengths, over the candidates of all documents: the
p-values' histogram, of a fixed size, is all that is gathered.

Runs of less than 20 characters aren't tested, as the tests have no power there, nor are runs without a
letter, which are numbers.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.bpe import slices
from fotolith.llm.shared import bounded_batches, written

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that the method looks at, and what may be around them.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{20}"
#: Written text, (probability that two letters are equal, class changes a character, correlation of
#: neighbours as vowels or not), where there is no text to measure them on.
WRITTEN = (0.062, 0.08, -0.25)
#: Lengths from which a new class of lengths begins.
LENGTHS = (20, 24, 28, 32, 40, 64, 128)
#: Steps of -log10 p in the histogram, and its highest.
STEPS, HIGHEST = 20, 60
FDR, UNIFORM = 0.01, 1e-4


def _log_normal_above(z: float) -> float:
    """log P(Z > z), also where P itself is 0 in floating point."""
    if z < 30:
        return math.log(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300))
    return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / (z * z))


def _log_chi_squared_above(x: float, df: int) -> float:
    """Wilson and Hilferty's approximation."""
    return _log_normal_above(((max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def _log_poisson_below(k: int, mean: float) -> float:
    """log P(X <= k): the sum from k down, which few terms make up far below the mean; near the mean of
    many, by the chi-squared law that it equals."""
    if mean <= 0:
        return 0.0
    if k > 64 and k >= 0.9 * mean:
        return _log_chi_squared_above(2 * mean, 2 * (k + 1))
    terms = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(k, max(k - 400, -1), -1)]
    top = max(terms)
    return min(0.0, top + math.log(sum(math.exp(t - top) for t in terms)))


def _log_poisson_above(k: int, mean: float) -> float:
    """log P(X >= k)."""
    if k <= 0 or mean <= 0:
        return 0.0 if k <= 0 else -math.inf
    if k <= mean:
        return math.log(max(-math.expm1(_log_poisson_below(k - 1, mean)), 1e-300))
    terms = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(k, k + 64 + int(mean))] if k < 4096 else [k * math.log(mean) - mean - math.lgamma(k + 1)]
    top = max(terms)
    return min(0.0, top + math.log(sum(math.exp(t - top) for t in terms)))


#: Of each byte: its class (0 white space, 1 digit, 2 upper, 3 lower, 4 other), the letter (26: none), and
#: whether it is a vowel.
CLASS = np.array([0 if b in b" \t\n\v\f\r" else 1 if 48 <= b < 58 else 2 if 65 <= b < 91 else 3 if 97 <= b < 123 else 4 for b in range(256)], np.uint8)
LETTER = np.array([(b | 32) - 97 if 97 <= (b | 32) < 123 and b < 128 else 26 for b in range(256)], np.uint8)
VOWEL = np.array([chr(b) in "aeiouAEIOU" for b in range(256)])


def habits(texts: pa.Array) -> np.ndarray:
    """Counts that the law of written text follows from: the 26 letters; neighbours that aren't white
    space, and those of another class; pairs of letters, their vowels on either side, and both vowels."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    kind, letter, vowel = CLASS[b], LETTER[b], VOWEL[b]
    near = (kind[1:] > 0) & (kind[:-1] > 0)
    both = (letter[1:] < 26) & (letter[:-1] < 26)
    return np.concatenate([np.bincount(letter, minlength=27)[:26], [near.sum(), (near & (kind[1:] != kind[:-1])).sum(), both.sum(), (both & vowel[1:]).sum() + (both & vowel[:-1]).sum(), (both & vowel[1:] & vowel[:-1]).sum()]]).astype(np.int64)


def law(counts: np.ndarray) -> tuple[float, float, float]:
    """The law of written text by these counts; WRITTEN where they are too few."""
    letters, (near, changes, pairs, vowels, double) = counts[:26].astype(float), counts[26:].astype(float)
    if letters.sum() < 1000 or pairs < 1000 or not 0 < vowels < 2 * pairs:
        return WRITTEN
    share = vowels / 2 / pairs
    return float(((letters / letters.sum()) ** 2).sum()), float(np.clip(changes / near, 1e-3, 0.5)), float((double / pairs - share * share) / (share * (1 - share)))


def alphabet(run: str) -> int:
    """Size of the least alphabet that holds the run."""
    body = run.rstrip("=")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return 16
    if re.fullmatch(r"[A-Z2-7]+", body):
        return 32
    if re.fullmatch(r"[a-z0-9]+|[A-Z0-9]+", body):
        return 36
    return 62 if body.isalnum() else 64


def battery(run: str, written_text: tuple[float, float, float] = WRITTEN) -> tuple[float, float]:
    """(least p-value under "at random", log of the joint p-value under "written text") of a run."""
    same, change, alternation = written_text
    b = np.frombuffer(run.rstrip("=").encode(), np.uint8)
    n, size = len(b), alphabet(run)
    counts = np.bincount(b, minlength=128).astype(np.int64)
    chi = size / n * float((counts**2).sum()) - n
    random = [math.exp(_log_chi_squared_above(chi, size - 1))]
    text = [_log_poisson_below(int((counts * (counts - 1) // 2).sum()), n * (n - 1) / 2 * same)]
    kind = CLASS[b]
    changes, shares = int((kind[1:] != kind[:-1]).sum()), np.bincount(kind, minlength=5) / n
    stay = float((shares**2).sum())
    expected = (n - 1) * (1 - stay)
    random.append(1.0 if expected < 1 else 2 * min(0.5, math.exp(_log_normal_above(abs(changes - expected) / math.sqrt(max(expected * stay, 0.5))))))
    text.append(_log_poisson_above(changes, (n - 1) * change))
    vowel = VOWEL[b].astype(float) - VOWEL[b].mean()
    spread = float((vowel**2).sum())
    r = float((vowel[1:] * vowel[:-1]).sum()) / spread if spread else 0.0
    random.append(2 * min(0.5, math.exp(_log_normal_above(abs(r + 1 / n) * math.sqrt(n)))))
    text.append(_log_normal_above((r - alternation) * math.sqrt(n)))
    x = min(-sum(max(p, -1e6) for p in text), 1e7)  # half of Fisher's statistic: Gamma of 3
    return min(random), -x + math.log(1 + x + x * x / 2)


def scan(text: str, written_text: tuple[float, float, float] = WRITTEN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """(base spans as kind, start, end; candidates as start, end, class of length, -log10 p)."""
    base = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], s[0]))
    more, starts = [], [x[1] for x in base]
    taken = [*itertools.accumulate((x[2] for x in base), max), 0]  # greatest end of the spans up to each; of none: 0
    for m in RUN.finditer(text):
        a, b = m.span()
        body = m[0].rstrip("=")
        if not any(c.isalpha() for c in body) or taken[max(bisect.bisect_left(starts, b) - 1, -1)] > a:
            continue
        uniform, p = battery(m[0], written_text)
        if uniform >= UNIFORM:
            more.append((a, b, sum(len(body) >= x for x in LENGTHS), min(max(-p / math.log(10), 0.0), HIGHEST)))
    return base, more


def secret_spans(df: DataFrame, column: str = "text", key: str = "doc_id", fdr: float = FDR) -> DataFrame:
    """Adds to the key `base` and `spans`, arrays of struct<kind:string,start:long,end:long> (code
    points, end exclusive): base spans, and those with what the method adds (kind `random`, never
    over a base span), both by start, then kind.

    Two narrow passes over the whole texts, to measure the law of written text and to scan; spans and
    p-values go to the shared folder, so that the last pass, which applies the thresholds, reads no text. Null and empty texts have no spans;
    rows are kept one for one, repeated ones and null keys too.
    """
    bounded_batches(df)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = habits(pc.fill_null(part.column("text"), ""))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], ["at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = pc.fill_null(part.column("text"), "")
            hit = np.flatnonzero(pc.match_substring_regex(texts, ANY).to_numpy(zero_copy_only=False))
            base, more = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
            for k, text in zip(hit, texts.take(pa.array(hit)).to_pylist()):
                found, extra = scan(text, written_text)
                base[k] = [{"k": a, "s": b, "e": c} for a, b, c in found]
                more[k] = [{"s": a, "e": b, "c": c, "p": p} for a, b, c, p in extra]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(base, base_type), pa.array(more, more_type)], ["key", "base", "more"])

    base_type = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
    more_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("c", pa.int32()), ("p", pa.float64())]))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("text"))
    counts = np.zeros(31, np.int64)
    for r in rows.select("text").mapInArrow(measure, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    written_text = law(counts)
    found = written(rows.mapInArrow(run, f"key {kind}, base array<struct<k:int,s:long,e:long>>, more array<struct<s:long,e:long,c:int,p:double>>"), "secrets")
    bins = found.select(F.explode("more").alias("m")).groupBy(F.col("m.c").alias("c"), F.floor(F.col("m.p") * STEPS).alias("bin")).count().collect()
    least = thresholds([(r["c"], r["bin"], r["count"]) for r in bins], fdr)
    names = F.array(*map(F.lit, KINDS))
    rule = F.create_map(*[x for c in range(len(LENGTHS) + 1) for x in (F.lit(c), F.lit(float(least.get(c, math.inf))))])
    more = F.transform(F.filter("more", lambda m: m["p"] >= F.element_at(rule, m["c"])), lambda m: F.struct(m["s"].alias("s"), F.lit(3).alias("k"), m["e"].alias("e")))
    base = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    shown = lambda spans: F.transform(F.array_sort(spans), lambda b: F.struct(names[b["k"]].alias("kind"), b["s"].alias("start"), b["e"].alias("end")))
    return found.select(F.col("key").alias(key), shown(base).alias("base"), shown(F.concat(base, more)).alias("spans"))


def thresholds(bins: list[tuple[int, int, int]], fdr: float) -> dict[int, float]:
    """For each class of lengths, the -log10 p from which candidates are kept: the largest set whose
    bins' largest p is at most fdr * rank / number."""
    out = {}
    for c in {b[0] for b in bins}:
        mine = sorted(((b, n) for d, b, n in bins if d == c), reverse=True)
        total, rank = sum(n for _, n in mine), 0
        for b, n in mine:
            rank += n
            if 10 ** (-b / STEPS) <= fdr * rank / total:
                out[c] = b / STEPS
    return out
