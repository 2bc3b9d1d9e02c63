"""Benchmark decontamination by spaced seeds (operator 1), in DataFrame functions only.

A mask is a list of token positions in a window; the others are ignored, so that a substituted token
there doesn't matter. Hashes of all masked windows of the benchmark are joined with those of the
documents; a hit gives a document, an item and the shift between them. Around the hits of a shift
the tokens are compared one by one: a window of WINDOW tokens with at least MATCHES equal ones is an
overlap (an item that is shorter is one window, with the same share).

The benchmark's hashes are broadcast in blocks of at most BLOCK, so what is sent is bounded whatever
the benchmark's size. Documents with a hit are read a second time, by their key and a hash of their
text, to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.llm.shared import written

WINDOW, MATCHES = 10, 8
#: Fixed masks by the length of the window: of any substitutions that it tolerates (two of ten tokens,
#: one of nine to five) some shift of one mask inside the window misses all. Shorter items are hashed whole.
MASKS = {
    10: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)),
    9: ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6)),
    8: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)),
    7: ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    5: ((0, 1, 2), (0, 1, 3)),
}
BLOCK = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masks(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of n tokens."""
    return MASKS.get(min(n, WINDOW), (tuple(range(n)),))


def seeds(words: Column, family: list[tuple[int, ...]]) -> Column:
    """array<struct<at, h>>: the hash of each mask at each place where it fits."""

    def one(mask: tuple[int, ...]) -> Column:
        last = F.size(words) - (mask[-1] + 1)
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        name = F.lit(sum(1 << p for p in mask))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(name, *[F.get(words, i + p) for p in mask]).alias("h")))

    return F.concat(*map(one, family))


def overlaps(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", column: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, shift (document place less item place), matched (equal tokens within overlaps),
    first and last (the overlaps' tokens in the document): one row for each document, item and shift
    that has an overlap.

    Null and empty texts and items have no tokens and no rows; rows with a null key or item take no
    part. Repeated rows (same key and text) count once, as do repeated items; a key with several
    texts has a row for each text's overlaps. No document is dropped or cut, however many hits.
    """
    items = written(benchmark.select(F.col(item).alias("item"), tokens(F.col(item_text)).alias("words")).where("item is not null and size(words) > 0").distinct(), "benchmark")
    sizes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())
    own = F.array().cast("array<struct<at:int,h:bigint>>")
    for n in sizes:
        own = F.when(F.least(F.size("words"), F.lit(WINDOW)) == n, seeds(F.col("words"), masks(n))).otherwise(own)
    family = sorted({m for n in sizes for m in masks(n)}) or [(0,)]
    marks = items.select("item", F.explode(own).alias("s"))
    marks = written(marks.select("item", F.col("s.at").alias("at"), F.col("s.h").alias("h")).distinct(), "seeds")
    blocks = max(1, -(-marks.count() // BLOCK))
    rows = documents.select(F.col(key).alias("key"), F.xxhash64(column).alias("version"), tokens(F.col(column)).alias("words")).where("key is not null")
    hashes = rows.select("key", "version", F.explode(seeds(F.col("words"), family)).alias("s")).select("key", "version", F.col("s.at").alias("at"), F.col("s.h").alias("h"))
    hits = None
    for b in range(blocks):
        block = marks.where(F.pmod(F.col("h"), F.lit(blocks)) == b).select("h", "item", F.col("at").alias("item_at"))
        part = hashes.join(F.broadcast(block), "h").select("key", "version", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        hits = part if hits is None else hits.unionAll(part)
    found = written(hits.distinct(), "hits")
    texts = documents.select(F.col(key).alias("key"), F.xxhash64(column).alias("version"), F.col(column).alias("text"))
    texts = texts.join(found.select("key", "version").distinct(), ["key", "version"], "left_semi").dropDuplicates(["key", "version"]).select("key", "version", tokens(F.col("text")).alias("words"))
    pairs = found.join(items.select("item", F.col("words").alias("other")), "item").join(texts, ["key", "version"])
    # only the item's stretch of the document goes on
    begin = F.greatest(F.col("shift"), F.lit(0))
    stretch = F.slice("words", begin + 1, F.size("other"))
    offset = begin - F.col("shift")  # places of the item before the document's start
    pairs = pairs.select("key", "item", "shift", begin.alias("begin"), F.zip_with(stretch, F.slice("other", offset + 1, F.size(stretch)), lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")).alias("same"), F.size("other").alias("n"))
    width = F.least(F.lit(WINDOW), F.col("n"))
    need = F.ceil(width * MATCHES / WINDOW)
    last = F.size("same") - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    good = F.filter(starts, lambda i: F.aggregate(F.slice("same", i + 1, width), F.lit(0), lambda a, x: a + x) >= need)
    out = pairs.withColumn("good", good).where(F.size("good") > 0).withColumn("width", width)
    covered = F.array_distinct(F.flatten(F.transform("good", lambda i: F.sequence(i, i + F.col("width") - 1))))
    matched = F.aggregate(covered, F.lit(0), lambda a, i: a + F.col("same")[i])
    return out.select(
        F.col("key").alias(key), F.col("item").alias(item), F.col("shift").cast("long").alias("shift"), matched.cast("long").alias("matched"),
        (F.col("begin") + F.array_min("good")).cast("long").alias("first"), (F.col("begin") + F.array_max("good") + F.col("width") - 1).cast("long").alias("last"),
    ).distinct()


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", **columns: str) -> DataFrame:
    """One row for each document and item that overlap: matched (of the best shift), overlaps (shifts),
    first and last token in the document."""
    return overlaps(documents, benchmark, key, item=item, **columns).groupBy(key, item).agg(F.max("matched").alias("matched"), F.count("*").alias("overlaps"), F.min("first").alias("first"), F.max("last").alias("last"))
