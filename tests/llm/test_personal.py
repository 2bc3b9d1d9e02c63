"""Personal data: what the trees add, long texts, and whole texts after redaction."""

import random
import time

from fotolith.llm import pii
from pyspark.sql import functions as F


def planted(n: int, seed: int = 1):
    """Texts with a base form, an oblique form or a look-alike each: (text, what it holds, its span)."""
    rng, out = random.Random(seed), []
    words = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper".split()
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = [int(c) for c in "4" + digit(14)]
        total = sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(body))
        return "".join(map(str, body)) + str(-total % 10)

    for i in range(n):
        name, host, a, b, c = rng.choice(words), rng.choice(words), digit(3), digit(3), digit(4)
        number, k = card(), i % 10
        t, what = [
            (f"{name}.{digit(2)}@{host}.example.com", "base"), (f"+1 ({a}) {b}-{c}", "base"), (number, "base"), (f"{rng.randint(1, 255)}.{rng.randint(10, 255)}.{rng.randint(10, 255)}.{rng.randint(10, 255)}", "base"),
            (f"{name} (at) {host} (dot) org", "email"), (f"({a}) {b}-{c}", "phone"), (".".join(number[j : j + 4] for j in range(0, 16, 4)), "card"),
            (f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", "none"), (digit(8).replace("0", "7"), "none"), (digit(11).replace("0", "3"), "none"),
        ][k]
        lead = " ".join(rng.choice(words) for _ in range(rng.randint(2, 9))) + " "
        out.append((lead + t + " " + rng.choice(words), what, (len(lead), len(lead) + len(t))))
    return out


def test_oblique_forms_are_added(spark):
    cases = planted(3000)
    got = {r["doc_id"]: r for r in pii.personal_spans(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    added = {i: {(s["kind"], s["start"], s["end"]) for s in r["spans"]} - {(s["kind"], s["start"], s["end"]) for s in r["base"]} for i, r in got.items()}
    assert all(not added[i] and got[i]["base"] for i, (_, what, _) in enumerate(cases) if what == "base")
    for kind in ("email", "phone", "card"):
        mine = [i for i, (_, what, _) in enumerate(cases) if what == kind]
        assert sum((kind, *cases[i][2]) in added[i] for i in mine) > 0.9 * len(mine), kind
    wrong = sum(bool(added[i]) for i, (_, what, _) in enumerate(cases) if what == "none")
    assert wrong < 0.02 * sum(map(len, added.values())), wrong


def test_a_long_text_takes_seconds(spark):
    text = "ab12 " * 100_000 + "+1 (555) 123-4567 1.2.3.4 é a@b.cd " * 8_000
    df = spark.createDataFrame([(1, text), (2, "x"), (3, None), (4, "")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.personal_spans(df, carry=("text",)).withColumn("clean", pii.redact(F.col("text"), F.col("spans"))).collect()}
    assert len(got[1]["base"]) == 24_000 and got[1]["clean"] == "ab12 " * 100_000 + "[PHONE] é [EMAIL] " * 8_000
    assert (got[2]["clean"], got[3]["clean"], got[4]["clean"]) == ("x", None, "")
    assert time.time() - began < 90


def test_running(spark):
    rows = [(list(range(n)),) for n in (0, 1, 63, 64, 65, 129, 1000)]
    got = spark.createDataFrame(rows, "v array<int>").select("v", pii.running(F.col("v"), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["v"][:k]) for k in range(len(r["v"]))] and r["m"] == [max([0, *r["v"][:k]]) for k in range(len(r["v"]))]


def test_redaction_of_overlaps(spark):
    text = "0123456789" * 40
    spans = [("ip", 3 * k, 3 * k + 1 + k % 5) for k in range(130)]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<kind:string,start:long,end:long>>")
    out, at = "", 0
    for _, a, b in spans:
        out += text[at:a] if a > at else ""
        if b > at:
            out, at = out + "[IP]", b
    assert df.select(pii.redact(F.col("text"), F.col("spans"))).first()[0] == out + text[at:]
