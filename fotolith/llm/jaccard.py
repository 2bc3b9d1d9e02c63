"""N-gram Jaccard join with a token-group matrix (operator 9).

Documents with the same set of shingles are one class, of which one is worked on. A link needs at
least a share `num / den` of a set in the other, so of any n - ceil(n * num / den) + 1 tokens of a
set one is in the other's. Each set's first so many tokens in one order of all tokens are its probe:
first those not known as frequent, by hash, then frequent ones by count. The list of frequent tokens
has a bounded size and only shapes that order: any order gives the same links.

The part of two sets up to the end of the shorter probe is known exactly from the probes; if it
differs in more tokens than two linked sets of these sizes can, the pair is none. Only pairs that
pass are compared by their whole sets.

Near copies of any number become one component by one comparison each: classes with the same least
permuted token of the probe are held against one leader of theirs. Groups of similar classes: the
components found so, and of classes without one those whose probes have the same most shared token; in
pieces of sets of about the same size, with at most about GROUP members and TOKENS tokens. The matrix has
a row for each probe token and piece: the piece's union of tokens, with the least and largest size of its
members and the place up to which all their probes tell everything. A query that shares a probe token with
a piece opens it only if the sizes fit and the overlap is bounded high enough: its tokens before the first
one in the union are in no member, nor are those that the union lacks up to that place (the whole probe,
if that ends there), and neither number may be more than a set linked to one of these sizes can lack. Of a
piece of one member, the query may lack no more either. A component's pieces are never opened from within.
Of what is opened, only pieces with a member that may be linked are compared by whole sets, inside one
task each, which returns a forest of the links and not each pair. The work left for a family of m
classes close to each other but not linked is about m * m / GROUP pieces opened.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from fotolith.llm.bpe import forget, give_back, slices
from fotolith.llm.components import components
from fotolith.llm.shared import bounded_batches, dropped, written
from fotolith.llm.words import hash_strings, mix64, shingle_hashes, split_words

#: A token among the least of at least FREQUENT sets is frequent, counted on a share 1 / SAMPLED of the
#: texts by their hash; the order knows at most LISTED of them, those in most sets.
SAMPLED, FREQUENT, LISTED = 8, 3, 1 << 18
#: Members of a piece and queries of a task at most, and tokens of either side, all by expectation.
GROUP, QUERIES, TOKENS = 256, 1024, 1 << 20
#: Bits a key, and at most in all, of the marks by which a worker passes over rows whose set isn't asked for.
MARKS, MOST_MARKS = 32, 1 << 28
#: Bytes of a group after which a worker gives its free memory back.
LARGE = 2 << 20
#: Bytes of text that a worker takes apart at a time, about.
SLICE = 1 << 20
SEED = np.uint64(0x5851F42D4C957F2D)
HEAVY, ALL = np.uint64(1 << 63), np.uint64(2**64 - 1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted set of each text's shingle hashes."""
    codes, words, offsets = split_words(texts)
    hashes, starts = shingle_hashes(hash_strings(words)[codes] if len(words) else np.zeros(0, np.uint64), offsets, width)
    return [np.unique(hashes[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def probe_size(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def probe(tokens: np.ndarray, num: int, den: int, listed: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, float]:
    """(places in the common order of a set's first tokens, share of the set that isn't frequent)."""
    n = len(tokens)
    at = np.minimum(np.searchsorted(listed, tokens), max(len(listed) - 1, 0))
    heavy = listed[at] == tokens if len(listed) else np.zeros(n, bool)
    light, size = tokens[~heavy] >> np.uint64(1), probe_size(n, num, den)
    if len(light) < size:
        light = np.concatenate([light, np.sort(places[at[heavy]]) | HEAVY])
    return light[:size], float((~heavy).mean())


def may_link(a: np.ndarray, n: int, b: np.ndarray, m: int, num: int, den: int) -> bool:
    """Whether sets of n and m tokens with these probes can be linked: how much they differ up to the
    end of the shorter probe (a probe that is its whole set has no end)."""
    end = min(a[-1] if len(a) < n else ALL, b[-1] if len(b) < m else ALL)
    x, y = a[: np.searchsorted(a, end, side="right")], b[: np.searchsorted(b, end, side="right")]
    if not len(x) or not len(y):
        same = 0
    else:
        same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return (len(x) + len(y) - 2 * same) * (den + num) <= (den - num) * (n + m)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return den * same >= num * (len(a) + len(b) - same)


def jaccard_components(df: DataFrame, width: int = 4, num: int = 85, den: int = 100, column: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles long, component_id (least key reachable by links, its own included) per row.

    A set holds the distinct runs of `width` words, or all words if fewer; null and empty texts have
    none and are linked with nothing, not even each other. Links: den * |A and B| >= num * |A or B|,
    exact up to collisions of 64-bit hashes. Rows with equal keys are one node, whatever their texts.
    Rows whose key is null have a null component, and join nothing.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("text"))
    bounded_batches(df)
    spark = df.sparkSession

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(part.column("text"), width)
            first = [s[: 2 * probe_size(len(s), num, den)] for s in {s.tobytes(): s for s in sets}.values() if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64) if first else [], pa.int64())], ["h"])

    some = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    often = some.mapInArrow(least, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    top = [(r["h"] & (2**64 - 1), r["count"]) for r in often.orderBy(F.desc("count"), "h").limit(LISTED).collect()]
    top = sorted((t, k) for k, (t, _) in enumerate(reversed(top)))
    frequent = spark.sparkContext.broadcast((np.array([t for t, _ in top], np.uint64), np.array([k for _, k in top], np.uint64)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        none = np.zeros(0, np.uint64)
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(part.column("text"), width)
            probes = [probe(s, num, den, *frequent.value) if len(s) else (none, 0.0) for s in sets]
            ends = [p[-1] if 0 < len(p) < len(s) else ALL for (p, _), s in zip(probes, sets)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([named(s) for s in sets], pa.int64()),
                    pa.array([p.view(np.int64) for p, _ in probes], pa.list_(pa.int64())), pa.array((np.array(ends, np.uint64) ^ HEAVY).view(np.int64)), pa.array([x for _, x in probes], pa.float64()),
                    pa.array([int(p[0].view(np.int64)) if len(p) else None for p, _ in probes], pa.int64()), pa.array([int(mix64(p ^ SEED).min().view(np.int64)) if len(p) else None for p, _ in probes], pa.int64()),
                ],
                ["key", "n", "node", "probe", "last", "light", "m0", "m1"],
            )

    signed = rows.mapInArrow(sign, f"key {kind}, n long, node long, probe array<long>, last long, light double, m0 long, m1 long")
    # rows without a set are classes by their key, so that equal keys still meet
    signed = written(signed.withColumn("node", F.when(F.col("n") > 0, F.col("node")).otherwise(F.xxhash64(F.lit("none"), "key"))), "signatures")
    frequent.destroy()
    classes = written(signed.where("key is not null").groupBy("node").agg(F.min("key").alias("rep"), F.max("n").alias("n")), "classes")
    links = _links(rows, signed, classes.where("n > 0"), width, num, den)
    by_key = signed.where("key is not null").groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("x")).where("u <> x").select("key", "u")
    same_key = signed.select("key", F.col("node").alias("v")).join(by_key, "key").where("u <> v").select("u", "v").distinct()
    found = written(components(links.unionAll(same_key)), "joined").join(classes, "node").select("node", "component", "rep")
    label = found.select("node", "component").join(found.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
    # a table, so that Spark can split the rows of a large class that meet it
    label = written(classes.join(label, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")), "labels")
    out = signed.select("key", "n", "node").join(label, "node", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"))
    out = written(out, "components")
    dropped(signed, classes, links, label)
    return out


def named(tokens: np.ndarray) -> int | None:
    """The 64-bit name of a set, by its tokens; null of an empty one."""
    return int.from_bytes(hashlib.md5(tokens).digest()[:8], "little", signed=True) if len(tokens) else None


def _links(rows: DataFrame, signed: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (u, v) between classes, by their nodes, enough of them for the components."""
    first = signed.join(classes.select("node", F.col("rep").alias("key")), ["node", "key"], "left_semi").dropDuplicates(["node", "key"])
    tokens = first.select("node", F.posexplode("probe").alias("at", "h"))
    shared = tokens.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    tokens = written(tokens.join(shared, "h"), "tokens")  # h, node, at, c
    some = written(first.join(tokens.select("node").distinct(), "node", "left_semi"), "probes")
    of = some.select("node", "key")

    stars = None
    for m in ("m0", "m1"):
        lead = some.groupBy(m).agg(F.min(F.struct("light", "node")).alias("x"), F.count("*").alias("size")).where("size > 1").select(m, F.col("x.node").alias("leader"))
        lead = lead.join(some.select(F.col("node").alias("leader"), F.col("probe").alias("other"), F.col("n").alias("on")), "leader")
        fit = (F.col("n") * den >= F.col("on") * num) & (F.col("on") * den >= F.col("n") * num) & (F.col("node") != F.col("leader"))
        part = some.select("node", "probe", "n", F.col(m).alias("by")).join(lead.withColumnRenamed(m, "by"), "by").where(fit)
        part = part.select("node", "probe", "n", "leader", "other", "on")
        stars = part if stars is None else stars.unionAll(part)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            ok = [may_link(x, n, y, m, num, den) for x, n, y, m in zip(_codes(b.column("probe")), b.column("n").to_pylist(), _codes(b.column("other")), b.column("on").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("leader")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))
        give_back()

    sketched = written(stars.mapInArrow(sketch, "u long, v long").distinct(), "stars")
    stars = written(_verified(rows, of, sketched, width, num, den), "star-links")
    most = tokens.groupBy("node").agg(F.max(F.struct("c", "h"))["h"].alias("top"))
    groups = some.select("node", "n", "last").join(most, "node").join(components(stars), "node", "left")
    name = F.coalesce(F.concat(F.lit("c"), F.col("component").cast("string")), F.concat(F.lit("t"), F.col("top").cast("string")))
    groups = named_ = written(groups.select("node", "n", "last", name.alias("group"), F.col("component").isNull().alias("loose")), "named")
    # sets of a step differ by less than linked ones may
    groups = groups.withColumn("step", F.floor(F.log("n") / math.log(max(den / num, 1 + 1e-3))))
    sizes = written(groups.groupBy("group", "step").agg(F.count("*").alias("size"), _parts(GROUP).alias("pieces")), "sizes")
    piece = F.col("step") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("pieces"))
    sized = written(groups.join(sizes, ["group", "step"]).withColumn("piece", piece).drop("pieces", "step"), "groups")
    dropped(sketched, named_, sizes)
    groups = sized

    by_token = tokens.drop("c").join(groups, "node")
    size = F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")  # of a probe
    lone = F.when(F.count("*") == 1, F.max(size)).otherwise(0)
    unions = groups.groupBy("group", "piece").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("last").alias("end"), F.max("size").alias("size"), F.max("loose").alias("loose"), lone.alias("lone"))
    matrix = by_token.select("h", "group", "piece").distinct().join(unions, ["group", "piece"])
    asked = by_token.select("h", "at", F.col("node").alias("query"), "n", "last", F.struct("size", "group", "piece").alias("mine"))
    its = F.struct("size", "group", "piece")
    other = ((F.col("mine.group") != F.col("group")) | F.col("loose")) & ((F.col("mine") < its) | ((F.col("mine") == its) & (F.col("size") > 1)))
    fit = other & (F.col("n") * den >= F.col("low") * num) & (F.col("high") * den >= F.col("n") * num)
    known = F.col("h").bitwiseXOR(F.lit(-(1 << 63))) <= F.col("end")
    # linked sets of n and m lack at most (den * n - num * m) / (den + num) and (den * m - num * n) / (den + num) of each other
    lacks = F.expr(f"(n * {den * den} - {num} * greatest(low * {den}, n * {num})) div {den * (den + num)}")
    theirs = F.expr(f"(high * {den} - n * {num}) div {den + num}")
    least = F.when(F.col("last") <= F.col("end"), size - lacks).otherwise(F.col("lone") - theirs)
    met = asked.join(matrix, "h").where(fit).groupBy(F.col("query").alias("node"), "n", "group", "piece", lacks.alias("lacks"), least.alias("least")).agg(F.min("at").alias("first"), F.max(F.when(known, F.col("at") + 1)).alias("known"), F.count_if(known).alias("found"))
    missing = F.greatest(F.col("first"), F.coalesce(F.col("known") - F.col("found"), F.lit(0)))
    opened = written(met.where((missing <= F.col("lacks")) & (F.col("found") >= F.col("least"))).select("node", "n", "group", "piece"), "opened")
    dropped(tokens)

    def near_group(queries: pa.Table, members: pa.Table) -> pa.Table:
        sides = [(_codes(t.column("probe").combine_chunks()), t.column("n").to_numpy(), t.column("node").to_pylist()) for t in (queries, members)]
        out = queries.select(["node", "n", "group", "piece"]).filter(pa.array(near_queries(*sides[0], *sides[1], num, den), pa.bool_()))
        cleared(queries, members)
        return out

    left, right, many = _sides(opened, groups, some.select("node", "probe"))
    hits = written(left.cogroup(right).applyInArrow(near_group, "node long, n long, group string, piece long"), "hits")
    dropped(opened, many)
    forest_links = _forest(rows, of, hits, groups, width, num, den)
    out = written(stars.unionAll(forest_links), "links")
    dropped(stars, hits, groups, some)
    return out


def _parts(rows: int) -> Column:
    """Parts for at most about so many rows and TOKENS tokens (column n) each."""
    return F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / TOKENS))


def _sides(opened: DataFrame, groups: DataFrame, what: DataFrame) -> tuple[GroupedData, GroupedData, DataFrame]:
    """Queries (node, n, group, piece) and members of the pieces they open, with the columns of what:
    a piece's queries are split into parts, each of which gets the piece's members; and the table of
    the parts, which is a table so that Spark can split the rows of a piece that meet it."""
    by = ["group", "piece", "part"]
    many = written(opened.groupBy("group", "piece").agg(_parts(QUERIES).alias("parts")), "parts")
    left = opened.join(many, ["group", "piece"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts").join(what, "node")
    right = groups.join(many, ["group", "piece"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").join(what, "node")
    left, right = (d.select(*(F.col(c).alias(c) for c in d.columns)) for d in (left, right))  # else the columns of one table on both sides are ambiguous
    return left.groupBy(*by), right.groupBy(*by), many


def _forest(rows: DataFrame, of: DataFrame, hits: DataFrame, groups: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between queries and members of the pieces they hit, by whole sets; of each task those
    that join what no other link of it has joined."""
    members = groups.join(hits.select("group", "piece").distinct(), ["group", "piece"], "left_semi")
    sets = _sets(rows, of, hits.select("node").unionAll(members.select("node")).distinct(), width)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(queries: pa.Table, members: pa.Table) -> pa.Table:
        if not len(queries) or not len(members):
            return schema.empty_table()
        q, m = ([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens").combine_chunks()] for t in (queries, members))
        keys, others = queries.column("node").to_pylist(), members.column("node").to_pylist()
        out = forest(q, keys, m, others, members.column("loose")[0].as_py(), num, den)
        cleared(queries, members)
        return pa.table({"u": [u for u, _ in out], "v": [v for _, v in out]}, schema=schema)

    left, right, many = _sides(hits, members, sets)
    out = written(left.cogroup(right).applyInArrow(compare, "u long, v long"), "forest")
    dropped(sets, many)
    return out


def cleared(*tables: pa.Table) -> None:
    """After large groups only, as there are many small ones."""
    forget()
    if sum(t.nbytes for t in tables) > LARGE:
        give_back()


def _codes(lists: pa.Array) -> list[np.ndarray]:
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _marks(keys: DataFrame) -> tuple[Column, np.ndarray]:
    """(the place of a row's key, a bit at the place of each of the keys): other keys seldom have a bit."""
    many = 1 << max(6, min(MOST_MARKS, MARKS * keys.count()).bit_length())
    place = F.pmod(F.xxhash64("key"), F.lit(many))
    words = keys.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(key), {many}) % 64 as int)))").alias("bits")).toArrow()
    marks = np.zeros(many // 64, np.uint64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return place, marks


def marked(marks: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a bit at their place."""
    for b in batches:
        place = b.column("place").to_numpy().astype(np.uint64)
        yield b.filter(pa.array((marks[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)))


def _sets(rows: DataFrame, of: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of these nodes: whole sets, sorted, as bytes. of: the key of a row with each node.
    Texts aren't shuffled: rows of other keys are passed over where they are read."""
    ends = written(of.join(nodes, "node", "left_semi"), "ends")
    place, bits = _marks(ends)
    marks = rows.sparkSession.sparkContext.broadcast(bits)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in slices(marked(marks.value, batches), "text", SLICE):
            sets = shingle_sets(part.column("text"), width)
            yield pa.RecordBatch.from_arrays([pa.array([named(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "tokens"])

    sets = rows.where("key is not null and text is not null").select(place.alias("place"), "text").mapInArrow(whole, "node long, tokens binary")
    sets = written(sets.join(ends.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")  # other texts have passed too, and a node may have many rows
    marks.destroy()
    dropped(ends)
    return sets


def _verified(rows: DataFrame, of: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that are linked, by their whole sets."""
    sets = _sets(rows, of, pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct(), width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(b.column("a"), b.column("b"))]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))
        give_back()

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("b")), "v")
    out = written(both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"), "verified")
    dropped(sets)
    return out


def postings(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all members, sorted; the place of each one's member)."""
    flat = np.concatenate(members)
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(np.arange(len(members)), [len(m) for m in members])[order]


def overlaps(q: np.ndarray, tokens: np.ndarray, holder: np.ndarray, many: int) -> tuple[int, np.ndarray]:
    """(tokens of q in the union, tokens of q in each of the members)."""
    a, b = np.searchsorted(tokens, q), np.searchsorted(tokens, q, side="right")
    times = b - a
    at = np.repeat(a - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    return int((times > 0).sum()), np.bincount(holder[at], minlength=many)


def near_queries(queries: list[np.ndarray], sizes: np.ndarray, keys: list, members: list[np.ndarray], others: np.ndarray, names: list, num: int, den: int) -> list[bool]:
    """Whether each query may be linked with a member of the piece other than itself, by the probes."""
    if not queries or not members:
        return [False] * len(queries)
    tokens, holder = postings(members)
    last = np.array([m[-1] if len(m) < n else ALL for m, n in zip(members, others)], np.uint64).min()  # what every member's probe tells
    high, out = int(others.max()), []
    for q, n, key in zip(queries, sizes.tolist(), keys):
        found, each = overlaps(q, tokens, holder, len(members))
        known = int((q <= last).sum())
        if (known - found) * (den + num) > (den - num) * (n + high):
            out.append(False)  # closed: too much of the query's probe is not in the union
            continue
        fit = np.flatnonzero((each > 0) & (others * den >= n * num) & (n * den >= others * num))
        out.append(any(names[m] != key and may_link(q, n, members[m], int(others[m]), num, den) for m in fit.tolist()))
    return out


def forest(queries: list[np.ndarray], keys: list, members: list[np.ndarray], names: list, loose: bool, num: int, den: int) -> list[tuple]:
    """Links (key, name) that join all that is linked here; members that aren't loose are joined already."""
    tokens, holder = postings(members)
    sizes, up, out = np.array([len(m) for m in members]), {}, []

    def top(x):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    if not loose:
        up = {m: names[0] for m in names}
    for q, key in zip(queries, keys):
        same = overlaps(q, tokens, holder, len(members))[1]
        for m in np.flatnonzero((same > 0) & (den * same >= num * (len(q) + sizes - same))).tolist():
            u, v = top(key), top(names[m])
            if u != v:
                up[u] = v
                out.append((key, names[m]))
    return out
