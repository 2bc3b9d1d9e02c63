"""Language ID by Bayesian evidence fusion (operator 8).

The text's likelihood under each language is a model of byte trigrams, fitted on at most SAMPLE
labelled rows. It is joined with three other kinds of evidence, whose tables come from grouped
aggregation over all rows, by the language that the text alone suggests: what language the markup
declares, the address's suffix, and the host. Host priors are smoothed towards those of the host's
domain, and these towards all rows. A row is left out of each table that it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.llm.bpe import forget, slices
from fotolith.llm.shared import bounded_batches, written

#: Labelled rows in the fit, at most; every language among them is known.
SAMPLE = 3_000
#: Bytes of text that a worker takes apart at a time, about.
SLICE = 1 << 20
CODES = 1 << 16
#: Weight of the next level in the host's and the domain's counts, and of an even spread elsewhere.
HOST, DOMAIN, EVEN = 8.0, 16.0, 1.0
#: A text's trigrams are not independent: its likelihood counts for this share, and by this many at most.
SHARE, MOST = 0.25, 400.0
LEAST = 0.5


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the byte trigrams of each text between spaces, offsets); case is folded, digits and
    marks are spaces."""
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = np.arange(256, dtype=np.uint32)
    plain[:97] = plain[123:128] = 32
    b = plain[data]
    offsets = offsets - offsets[0]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    ok = (b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))
    ok &= np.arange(len(ok)) + 2 < np.repeat(offsets[1:], np.diff(offsets))[: len(ok)]
    return code[ok].astype(np.int64), np.concatenate([[0], np.cumsum(ok), np.full(2, ok.sum())])[offsets]


class Model:
    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.log((counts + 0.5) / (total + 0.5 * CODES)).astype(np.float32) if len(names) else np.zeros((0, CODES), np.float32)

    def likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each text under each language, trigrams of each)."""
        codes, offsets = trigrams(texts)
        n = np.diff(offsets)
        out = np.zeros((len(texts), len(self.names)))
        for k, row in enumerate(self.table):
            sums = np.concatenate([[0.0], np.cumsum(row[codes], dtype=np.float64)])
            out[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
        return out, n


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Trigram counts of each language over at most `sample` rows, the first by a hash of the key."""
    spark = labelled.sparkSession
    bounded_batches(labelled)
    rows = labelled.select(F.col(key).alias("key"), F.col(label).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null and key is not null")
    chosen = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(sample)
    chosen = spark.createDataFrame([(r["key"],) for r in chosen.collect()], f"key {rows.schema['key'].dataType.simpleString()}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices(iter([b]), "text", SLICE):
                codes, offsets = trigrams(part.column("text"))
                langs = part.column("lang").to_pylist()
                which = np.repeat(np.arange(len(langs)), np.diff(offsets))
                for name in set(langs):
                    mine = np.array([x == name for x in langs])
                    total[name] = total.get(name, 0) + np.bincount(codes[mine[which]], minlength=CODES)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": [*total], "counts": [t.astype("<i8").tobytes() for t in total.values()]})

    parts = rows.join(F.broadcast(chosen), "key", "left_semi").select("lang", "text").coalesce(4).mapInArrow(count, "lang string, counts binary").collect()
    sums: dict[str, np.ndarray] = {}
    for r in parts:
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["counts"], "<i8")
    names = sorted(sums)
    return Model(names, np.array([sums[k] for k in names]) if names else np.zeros((0, CODES)))


def identify(df: DataFrame, model: Model, key: str, text: Column, declared: Column, suffix: Column, host: Column, domain: Column, **carry: Column) -> DataFrame:
    """key, lang, confidence (its posterior), text_lang (by the text alone) and accepted, and the columns
    to carry, for each row.

    Rejected: texts without a letter, texts that every language makes less likely than evenly spread
    trigrams, and posteriors below LEAST. Null evidence counts as none; null and empty texts are
    rejected with a null language, as is everything if there is no labelled row. Rows are kept one
    for one. Only a few numbers a row are shuffled, to meet their host's counts, which are combined
    before their shuffle; a host's rows may be split among tasks.
    """
    spark = df.sparkSession
    bounded_batches(df)
    sent = spark.sparkContext.broadcast(model)
    names = model.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = sent.value
        for part in slices(batches, "text", SLICE):
            like, n = m.likelihoods(part.column("text"))
            fine = n > 0
            best = like.argmax(axis=1) if len(m.names) else np.zeros(len(n), int)
            if len(m.names):
                fine = fine & (like.max(axis=1) > -n * np.log(CODES))
                like = np.clip((like - like.max(axis=1, keepdims=True)) * SHARE, -MOST, 0)
            else:
                fine = np.zeros(len(n), bool)
            yield pa.RecordBatch.from_arrays([*(c for c, f in zip(part.columns, part.schema) if f.name != "text"), pa.array(like.tolist(), pa.list_(pa.float64())), pa.array(best.astype(np.int32)), pa.array(fine)], [*(f.name for f in part.schema if f.name != "text"), "like", "best", "fine"])

    rows = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((declared, "declared"), (suffix, "suffix"), (host, "host"), (domain, "domain"))], *[c.alias(f"_{n}") for n, c in carry.items()])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    rows = written(rows.mapInArrow(run, f"{kept}, like array<double>, best int, fine boolean"), "likelihoods")
    sent.destroy()
    size = len(names)
    each = F.array(*[F.count_if(F.col("best") == k).cast("double") for k in range(size)]) if size else F.array().cast("array<double>")
    fine = rows.where("fine")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    total = fine.groupBy().agg(each.alias("n")).first()["n"]
    spread = [(x + EVEN) / (sum(total) + EVEN * size) for x in total]
    even = F.array(*map(F.lit, spread)) if size else F.array().cast("array<double>")
    totals = F.array(*map(F.lit, total)) if size else even
    none = F.transform(even, lambda x: F.lit(0.0))

    found = rows
    for on in ("declared", "suffix", "domain", "host"):
        found = found.join(fine.where(F.col(on) != "").groupBy(on).agg(each.alias(f"{on}_n")), on, "left")
    own = F.transform(F.sequence(F.lit(0), F.lit(max(size - 1, 0))), lambda k: (F.col("fine") & (F.col("best") == k)).cast("double")) if size else even
    less = lambda c: F.zip_with(F.coalesce(c, F.transform(own, lambda x: x)), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    for on in ("declared", "suffix", "domain", "host"):
        found = found.withColumn(f"{on}_n", less(F.col(f"{on}_n")))

    def share_of(on: str) -> Column:
        """log P(value | language), up to a factor that the languages share; nothing if no other row has the value."""
        others = F.zip_with(F.col(f"{on}_n"), F.zip_with(totals, own, lambda n, o: F.greatest(n - o, F.lit(0.0))), lambda a, n: F.log((a + EVEN) / (n + EVEN * 2)))
        return F.when((F.col(on) != "") & (add(F.col(f"{on}_n")) > 0), others).otherwise(none)

    found = found.withColumn("domain_p", F.zip_with("domain_n", even, lambda a, e: (a + DOMAIN * e) / (add(F.col("domain_n")) + DOMAIN)))
    found = found.withColumn("prior", F.zip_with("host_n", "domain_p", lambda a, p: (a + HOST * p) / (add(F.col("host_n")) + HOST)))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    found = found.withColumn("sum", plus(plus("like", F.transform("prior", lambda p: F.log(p))), plus(share_of("declared"), share_of("suffix"))))
    top = F.array_max("sum")
    found = found.withColumn("confidence", 1 / add(F.transform("sum", lambda x: F.exp(x - F.array_max("sum")))))
    label = F.array(*map(F.lit, names)) if size else F.array().cast("array<string>")
    lang = F.get(label, (F.array_position("sum", top) - 1).cast("int"))
    accepted = F.col("fine") & (F.col("confidence") >= LEAST)
    return found.select(F.col("key").alias(key), F.when(F.col("fine"), lang).alias("lang"), F.when(F.col("fine"), F.round("confidence", 6)).alias("confidence"), F.when(F.col("fine"), F.get(label, F.col("best"))).alias("text_lang"), F.coalesce(accepted, F.lit(False)).alias("accepted"), *[F.col(f"_{n}").alias(n) for n in carry])


def document_languages(documents: DataFrame, model: Model | None = None, declared: str | None = "lang", **carry: Column) -> DataFrame:
    """Documents: the source is the host (its letters the domain), `declared` the column of the language
    that came with the document, if any."""
    model = model or fit(documents)
    said = F.col(declared) if declared else F.lit(None)
    return identify(documents, model, "doc_id", F.col("text"), said, F.lit(None), F.col("source"), F.regexp_replace("source", "[0-9]+$", ""), **carry)


def page_languages(pages: DataFrame, model: Model) -> DataFrame:
    """Pages: the text without markup, the first html tag's lang attribute, the path's or else the host's
    suffix. Scripts, styles and comments that aren't closed go to the end. Patterns take linear time."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    path = F.lower(F.regexp_extract("url", r"://[^/]*/([A-Za-z]{2})(?:/|$)", 1))
    suffix = F.when(path != "", F.concat(F.lit("/"), path)).otherwise(F.regexp_extract(host, r"\.([a-z]+)$", 1))
    declared = F.lower(F.regexp_extract(F.regexp_extract("html", r"(?i)<html\b([^>]*+)", 1), r"(?i)\slang\s*=\s*[\"']?([A-Za-z]+)", 1))
    hidden = r"(?is)<(script|style)\b[^>]*+(?:>.*?(?:</\1|\z)|\z)|<!--.*?(?:-->|\z)"
    text = F.regexp_replace(F.regexp_replace("html", hidden, " "), r"<[^<>]*+>", " ")
    return identify(pages, model, "page_id", text, declared, suffix, host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))
