"""What the join sends: texts aren't shuffled, and pieces are closed only if none of their members can be linked."""

import random

import pytest

from fotolith.llm import jaccard


@pytest.fixture
def tables(monkeypatch):
    """(name, rows, plan) of the tables that the join writes."""
    out, write = [], jaccard.written

    def written(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        table = write(df, name)
        out.append((name, table.count(), plan))
        return table

    monkeypatch.setattr(jaccard, "written", written)
    return out


def test_texts_are_not_shuffled_for_whole_sets(spark, tables):
    texts = [" ".join(f"w{i // 2}x{k}" for k in range(60 + i % 2)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        got = jaccard.jaccard_components(df).collect()
    finally:
        spark.conf.set(name, before)
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)
    assert not any("hashpartitioning(key" in plan for name, _, plan in tables if name == "sets")


@pytest.mark.parametrize("share", [(85, 100), (80, 100), (1, 2), (1, 1)])
def test_bounds_of_pieces_lose_no_link(spark, share):
    """Families of sizes of their own at and about the limit, against all pairs."""
    draw, texts = random.Random(5), []
    for f in range(25):
        n = draw.choice([4, 5, 7, 12, 30, 60, 90])
        words = [f"f{f}x{k}" for k in range(n)]
        for _ in range(8):
            cut, more = draw.randrange(n // 4 + 2), draw.randrange(n // 4 + 2)
            texts.append(" ".join(words[cut:] + [f"g{draw.randrange(99)}y{k}" for k in range(more)]))
    sets = [set(s.tolist()) for s in jaccard.shingle_sets(jaccard.pa.array(texts), 4)]
    up = list(range(len(sets)))
    for _ in range(len(sets)):
        old = list(up)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and share[1] * len(a & b) >= share[0] * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
        if up == old:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df, 4, *share).collect()} == dict(enumerate(up))
