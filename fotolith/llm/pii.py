"""Personal data by candidate gradient boosting (operator 4), in DataFrame functions only.

Four patterns give the base spans. Generators of high recall propose more spans, which may overlap
them: addresses written out with (at) and (dot), and any run of at least seven digits with
separators, as an address, a card or a telephone number by its format. Boosted trees score each
proposal by its format and its surroundings.

There are no labels, and the forms that the base finds need no trees. So the trees learn from forms
that it misses: every base span, rewritten obliquely (without its plus, with other separators, written
out) in its own surroundings, is a positive; a look-alike made of its digits (a date, a bare number, a
number failing its check, an address out of range) is a negative, and so are the proposals that can't
be meant: those that touch a letter or a mark of names and paths, have no separator, or as long as a
card fail its check. Other proposals have no label and take no part in the fit. The trees are fitted on
the driver on the distinct feature vectors, weighted by their numbers; half of the keys, by their hash,
calibrate each kind's threshold, the least score above which a share PRECISION is positive. Scoring is a
CASE expression. Proposals over their kind's threshold that overlap no base span are added.

Patterns are written so that matching is linear: runs are possessive, and a match may begin only at
the start of a run or where the last match ended, the only places where the leftmost match can.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSE_EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?{HOST}++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?){HOST}++)++"
PROPOSE_NUMBER = r"(?:(?<![0-9])|\G)[+(]{0,2}[0-9](?:[\x20().:-]{0,2}[0-9])++"
WORDS = r"(?i)phone|tel|call|mobile|fax|contact|card|visa|pay|mail|host|addr|server|ip"
PRECISION, TREES, DEPTH, RATE, BINS = 0.98, 24, 3, 0.3, 16
FEATURES = ("kind", "digits", "size", "separators", "groups", "plus", "luhn", "dots", "touches_before", "touches_after", "word_before", "digits_around")
BEFORE, AFTER = 24, 16

_NONE = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
#: Values of a block in a running total.
STEP = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), which is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints, op over 0 and all those before it; in blocks, as an array that grows
    by one is copied each time."""
    none = F.array().cast("array<int>")

    def scan(part: Column, one: Callable[[Column], Column]) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, x: F.struct(op(acc["at"], one(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def joined(blocks: Column) -> Column:
        begin = scan(blocks, lambda b: b["at"])["out"]
        return F.flatten(F.zip_with(blocks, begin, lambda b, a: F.transform(b["out"], lambda x: op(a, x))))

    def cut(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / STEP).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: scan(F.slice(values, k * STEP + 1, F.lit(STEP)), lambda x: x))
        return F.when(F.size(values) == 0, none).otherwise(bound(blocks, joined))

    return bound(values, cut)


def matches(text: Column, pattern: str, needs: Column) -> Column:
    """All matches with their places (code points) and what is around them; texts without `needs` are
    not searched."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(x: Column) -> Column:
        m, g = x["m"], x["g"]
        begin = running(F.transform(m, lambda t, i: F.length(F.get(g, i)) + F.length(t)), lambda a, b: a + b)
        some = lambda c: F.coalesce(c, F.lit(""))

        def one(t: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(g, i))
            before = F.right(F.concat(some(F.get(m, i - 1)), F.get(g, i)), F.lit(BEFORE))
            after = F.left(F.concat(some(F.get(g, i + 1)), some(F.get(m, i + 1))), F.lit(AFTER))
            return F.struct(start.alias("start"), (start + F.length(t)).alias("end"), t.alias("text"), before.alias("before"), after.alias("after"))

        return bound(begin, lambda at: F.transform(m, lambda t, i: one(t, i, at)))

    return F.when(needs, bound(F.struct(found.alias("m"), gaps.alias("g")), placed)).otherwise(F.array().cast(_NONE))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def octets(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, text, before, after>> of the base, kind as its place in KINDS, by
    start, then kind."""
    number = F.regexp_like(text, F.lit("[0-9]"))
    n = lambda m: F.length(digits(m["text"]))
    found = {
        "email": matches(text, BASE["email"], F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, BASE["ip"], number), lambda m: octets(m["text"])),
        "card": F.filter(matches(text, BASE["card"], number), lambda m: n(m).between(14, 19) & luhn(digits(m["text"]))),
        "phone": F.filter(matches(text, BASE["phone"], number & F.contains(text, F.lit("+"))), lambda m: n(m).between(10, 15)),
    }

    def placed(i: int) -> Column:
        return F.transform(found[KINDS[i]], lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["text"].alias("text"), m["before"].alias("before"), m["after"].alias("after")))

    return F.array_sort(F.concat(*map(placed, range(len(KINDS)))))


def features(text: Column, before: Column, after: Column, kind: Column) -> Column:
    """The features of FEATURES, bounded, so that their vectors are."""
    flag, least = lambda c: c.cast("double"), lambda c, most: F.least(c, F.lit(most)).cast("double")
    d = digits(text)
    return F.array(
        flag(kind), least(F.length(d), 24), least(F.length(text), 48), least(F.length(text) - F.length(d), 24), least(F.size(F.split(text, "[^0-9]+")), 8), flag(F.startswith(text, F.lit("+"))),
        flag(F.length(d) > 0) * flag(luhn(F.left(d, F.lit(24)))), least(F.length(F.regexp_replace(text, "[^.]", "")), 8), flag(F.regexp_like(before, F.lit(r"[\p{L}\p{N}_=/-]$"))),
        flag(F.regexp_like(after, F.lit(r"^[\p{L}\p{N}_=/-]"))), flag(F.regexp_like(before, F.lit(WORDS))), least(F.length(digits(before)) + F.length(digits(after)), 16),
    )


def kind_of(text: Column) -> Column:
    """The kind of a run of digits, by its format."""
    d = F.length(digits(text))
    return F.when(F.regexp_like(text, F.lit(r"^[0-9]{1,3}(?:[\x20().:-]{1,2}[0-9]{1,3}){3}$")), 1).when((d >= 13) & ~F.startswith(text, F.lit("+")), 2).otherwise(3)


def proposals(text: Column) -> Column:
    """array<struct<start, kind, end, x array<double>>> of the generators' spans with their features."""
    mail = matches(text, PROPOSE_EMAIL, F.contains(text, F.lit("@")) | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")))
    number = F.filter(matches(text, PROPOSE_NUMBER, F.regexp_like(text, F.lit("[0-9]"))), lambda m: F.length(digits(m["text"])) >= 7)
    described = lambda m, kind: F.struct(m["start"].alias("start"), kind.alias("kind"), m["end"].alias("end"), features(m["text"], m["before"], m["after"], kind).alias("x"))
    return F.concat(F.transform(mail, lambda m: described(m, F.lit(0))), F.transform(number, lambda m: described(m, kind_of(m["text"]))))


def lessons(found: Column) -> Column:
    """array<struct<x array<double>, positive boolean>>: each base span written obliquely, and a
    look-alike; which forms, its hash decides."""

    def pick(t: Column, *forms: Column) -> Column:
        k = F.pmod(F.xxhash64(t, F.lit("form")), F.lit(len(forms)))
        return F.get(F.array(*forms), k.cast("int"))

    def grouped(d: Column, by: str, mark: str) -> Column:
        return F.regexp_replace(F.regexp_replace(d, by, "$1" + mark), r"[\x20.:-]+$", "")

    def oblique(s: Column) -> Column:
        t, d = s["text"], digits(s["text"])
        mail = pick(t, F.regexp_replace(F.regexp_replace(t, "@", " (at) "), r"\.(?=[^.]*$)", " (dot) "), F.regexp_replace(F.regexp_replace(t, "@", "[at]"), r"\.(?=[^.]*$)", "[dot]"), F.regexp_replace(t, "@", " @ "))
        ip = pick(t, F.regexp_replace(t, r"\.", "-"), F.regexp_replace(t, r"\.", ". "), F.regexp_replace(t, r"\.", ":"))
        card = pick(t, grouped(d, "([0-9]{4})", "."), grouped(d, "([0-9]{4})", ": "), grouped(d, "([0-9]{4})", "--"))
        ten = F.right(d, F.lit(10))
        local = F.concat(F.lit("("), F.left(ten, F.lit(3)), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.right(ten, F.lit(4)))
        phone = pick(t, F.regexp_replace(t, r"^\+", ""), local, F.regexp_replace(ten, "^([0-9]{3})([0-9]{3})", "$1.$2."), F.regexp_replace(ten, "^([0-9]{3})([0-9]{3})", "$1-$2-"))
        return F.get(F.array(mail, ip, card, phone), s["kind"])

    def alike(s: Column) -> Column:
        t, d = s["text"], F.concat(digits(s["text"]), F.lit("10203040"))
        day = F.concat(F.lit("20"), F.substring(d, 1, 2), F.lit("-0"), F.substring(d, 3, 1), F.lit("-1"), F.substring(d, 4, 1))
        wrong = F.concat(F.left(d, F.lit(15)), ((F.ascii(F.substring(d, 16, 1)) - 47) % 10).cast("string"))
        wide = F.concat_ws(".", F.concat(F.lit("9"), F.substring(d, 1, 2)), F.substring(d, 3, 3), F.substring(d, 5, 3), F.substring(d, 2, 3))
        return pick(t, day, F.concat(day, F.lit(" 1"), F.substring(d, 5, 1), F.lit(":"), F.substring(d, 5, 2)), F.left(d, F.lit(8)), F.left(d, F.lit(11)), wrong, wide)

    def one(s: Column, text: Column, kind: Column, positive: bool) -> Column:
        return F.struct(features(text, s["before"], s["after"], kind).alias("x"), F.lit(positive).alias("positive"))

    def both(spans: Column) -> Column:
        good = F.transform(spans, lambda s: bound(oblique(s), lambda t: one(s, t, F.when(s["kind"] == 0, 0).otherwise(kind_of(t)), True)))
        bad = F.transform(spans, lambda s: bound(alike(s), lambda t: one(s, t, kind_of(t), False)))
        return F.concat(good, bad)

    return bound(found, both)


class Trees:
    """Boosted trees for the logistic loss, fitted by histograms of gradients."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, times: np.ndarray | None = None):
        self.times = np.ones(len(y)) if times is None else times
        share = np.clip(np.average(y, weights=self.times), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], weights=self.times, method="inverted_cdf")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        self.trees, score = [], np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._grow(binned, self.times * (y - p), self.times * p * (1 - p), np.arange(len(y)), depth, rate))
            score += self.values(x, self.trees[-1:])

    def _grow(self, binned, g, h, rows, depth, rate):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if not depth or self.times[rows].sum() < 20:
            return leaf
        total_g, total_h = g[rows].sum(), h[rows].sum()
        gain, choice = 1e-3, None
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            gs = np.bincount(binned[rows, f], g[rows], len(edges) + 1).cumsum()[:-1]
            hs = np.bincount(binned[rows, f], h[rows], len(edges) + 1).cumsum()[:-1]
            gains = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            if gains.max() > gain:
                gain, choice = gains.max(), (f, int(gains.argmax()))
        if choice is None:
            return leaf
        f, b = choice
        left = binned[rows, f] <= b
        if left.all() or not left.any():
            return leaf
        return f, float(self.edges[f][b]), self._grow(binned, g, h, rows[left], depth - 1, rate), self._grow(binned, g, h, rows[~left], depth - 1, rate)

    def values(self, x: np.ndarray, trees=None) -> np.ndarray:
        def value(t, rows):
            if isinstance(t, float):
                return np.full(len(rows), t)
            out, left = np.empty(len(rows)), x[rows, t[0]] <= t[1]
            out[left], out[~left] = value(t[2], rows[left]), value(t[3], rows[~left])
            return out

        every = np.arange(len(x))
        return sum((value(t, every) for t in (self.trees if trees is None else trees)), np.zeros(len(x)) + (self.bias if trees is None else 0))

    def column(self, x: Column) -> Column:
        def value(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(x[t[0]] <= F.lit(t[1]), value(t[2])).otherwise(value(t[3]))

        total = F.lit(self.bias)
        for t in self.trees:
            total = total + value(t)
        return total


def calibrated(scores: np.ndarray, y: np.ndarray, precision: float = PRECISION, times: np.ndarray | None = None) -> float:
    """The least score from which a share `precision` is positive; infinite if there is none."""
    order = np.argsort(-scores, kind="stable")
    times = np.ones(len(y)) if times is None else times
    share = np.cumsum((y * times)[order]) / np.cumsum(times[order])
    last = np.r_[scores[order][1:] != scores[order][:-1], True]  # equal scores go together
    good = np.flatnonzero((share >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else float("inf")


def free(found: Column, spans: Column) -> Column:
    """The proposals that overlap none of the spans: both are sorted together, so that the greatest end
    of the spans before a proposal and the least start of those after it tell."""
    far = F.lit(2**31 - 1)
    most = lambda a, b: F.greatest(a, b)

    def chosen(e: Column) -> Column:
        before = running(F.transform(e, lambda x: F.when(x["i"] < 0, x["end"]).otherwise(0)), most)
        after = running(F.reverse(F.transform(e, lambda x: F.when(x["i"] < 0, far - x["start"]).otherwise(0))), most)
        alone = lambda x, i, r: (F.get(r["before"], i) <= x["start"]) & (far - F.get(r["after"], F.size(e) - 1 - i) >= x["end"])
        return bound(F.struct(before.alias("before"), after.alias("after")), lambda r: F.filter(F.transform(e, lambda x, i: F.when((x["i"] >= 0) & alone(x, i, r), x["i"])), lambda k: k.isNotNull()))

    def both(s: Column) -> Column:
        entry = lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["end"].alias("end"))
        entries = F.array_sort(F.concat(F.transform(s["b"], lambda b: entry(b, F.lit(-1))), F.transform(s["p"], entry)))
        return F.transform(bound(entries, chosen), lambda k: F.get(s["p"], k))

    return F.when(F.size(spans) == 0, found).otherwise(bound(F.struct(found.alias("p"), spans.alias("b")), both))


def personal_spans(df: DataFrame, column: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, `base` and `spans` (arrays of struct<kind:string,start:long,end:long>, code points, end
    exclusive, by start, then kind), and the `carry` columns.

    One narrow pass over the whole texts; the spans, without texts, are written to the shared folder
    for the fit and the second pass. Null and empty texts have no spans; rows are kept one for one.
    If the half to fit on has no positive or no negative, nothing is added to the base. The driver gets
    a row for each distinct feature vector, whose number the bounded features limit.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    parts = lambda b: F.struct(F.transform(b, plain).alias("b"), free(proposals(text), b).alias("p"), lessons(b).alias("lessons"))
    found = df.select(F.col(key).alias("_key"), *carry, bound(base_spans(text), parts).alias("x")).select("_key", *carry, "x.*")
    found = written(found, "personal")
    f = {name: k for k, name in enumerate(FEATURES)}
    no = lambda x: (x[f["touches_before"]] + x[f["touches_after"]] > 0) | (x[f["separators"]] == 0) | ((x[f["kind"]] == 2) & (x[f["luhn"]] == 0))
    real = F.transform(F.filter("p", lambda p: no(p["x"])), lambda p: F.struct(p["x"].alias("x"), F.lit(False).alias("positive")))
    every = found.select((F.pmod(F.xxhash64("_key"), F.lit(2)) == 0).alias("fit"), F.explode(F.concat("lessons", real)).alias("p")).groupBy("fit", "p.x", "p.positive").agg(F.count("*").alias("times"))
    score, least = fitted([(r["x"], r["positive"], r["times"], r["fit"]) for r in every.orderBy("fit", "x", "positive").collect()])
    more = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if score is not None:
        limit = F.array(*map(F.lit, least))
        more = F.transform(F.filter("p", lambda p: score.column(p["x"]) >= limit[p["kind"]]), plain)
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.transform(spans, lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    return found.select(F.col("_key").alias(key), *carry, shown(F.col("b")).alias("base"), shown(F.array_sort(F.concat("b", more))).alias("spans"))


def fitted(rows: list) -> tuple[Trees | None, list[float]]:
    """Trees fitted on the rows (x, positive, times, fit) with `fit`, and each kind's threshold, calibrated on the rest."""
    none = [float("inf")] * len(KINDS)
    if not rows:
        return None, none
    x, y = np.array([r[0] for r in rows], float), np.array([bool(r[1]) for r in rows], float)
    times, fit = np.array([r[2] for r in rows], float), np.array([bool(r[3]) for r in rows])
    if len(set(y[fit])) < 2 or fit.all():
        return None, none
    trees = Trees(x[fit], y[fit], times=times[fit])
    rest = [~fit & (x[:, 0] == k) for k in range(len(KINDS))]
    return trees, [calibrated(trees.values(x[r]), y[r], times=times[r]) if r.any() else float("inf") for r in rest]


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first is
    replaced and the others are cut to what follows it, without a mark if nothing does. Spans are taken
    in blocks, each on its own stretch of the text, so that long texts with many spans stay cheap."""

    def marked(s: Column, stretch: Column, offset: Column, at: Column) -> Column:
        gap = F.substring(stretch, at - offset + 1, F.greatest(s["start"].cast("int") - at, F.lit(0)))
        return F.concat(gap, F.when(s["end"] > at, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))

    def block(x: Column, k: Column) -> Column:
        first = k * STEP
        offset = F.get(x["at"], first)
        end = F.coalesce(F.get(x["at"], first + STEP), x["last"])
        stretch = F.substring(x["text"], offset + 1, end - offset)
        part = F.slice(x["spans"], first + 1, F.lit(STEP))
        return F.array_join(bound(F.struct(stretch.alias("t"), offset.alias("o")), lambda b: F.transform(part, lambda s, i: marked(s, b["t"], b["o"], F.get(x["at"], first + i)))), "")

    def whole(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["spans"]) - 1) / STEP).cast("int")), lambda k: block(x, k))
        return F.concat(F.array_join(blocks, ""), F.substring(x["text"], x["last"] + 1, F.length(x["text"])))

    def ready(s: Column) -> Column:
        ends = F.transform(s, lambda v: v["end"].cast("int"))
        x = F.struct(text.alias("text"), s.alias("spans"), running(ends, lambda a, b: F.greatest(a, b)).alias("at"), F.array_max(ends).alias("last"))
        return bound(x, whole)

    return F.when(F.size(spans) == 0, text).otherwise(bound(spans, ready))
