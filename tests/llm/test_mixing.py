"""Source mixing against a plain computation."""

import hashlib
import random

import pytest
from pyspark.sql import types as T

from intentlane.llm.mixing import mix_sources

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("size", T.StringType()),
                       T.StructField("target", T.StringType()), T.StructField("h", T.StringType())])


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def data(seed):
    rnd = random.Random(seed)
    sources = ["a", "B", "", "zé", "\U0001f600", None]
    out = []
    for i in range(400):
        src = "a" if rnd.random() < 0.4 else rnd.choice(sources)
        out.append((i, " \t".join(["w"] * rnd.choice([0, 1, 5, 300])), src, "c", "c", "c"))
    out += [(900, None, "a", None, None, None), (None, "x y z", "B", None, None, None), (None, "x y", None, None, None, None),
            (7, "again and again", "zé", None, None, None), (7, "again and again", "zé", None, None, None),
            (901, "word " * 20000, "a", None, None, None)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_selection(spark, seed):
    rows = data(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + size(r[1])
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:  # off by less than a word for each document that shares the threshold hash
        assert abs(taken[s] - want[s]) <= 3
    # every document below the threshold is read once more than every document above it
    for s in sizes:
        low = sorted((hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest(),
                      r["taken"] / r["size"]) for r in got if r["source"] == s and r["size"])
        ratios = [x for _, x in low]
        assert all(a >= b - 1e-9 for a, b in zip(ratios, ratios[1:]))
    assert sorted(map(str, mix_sources(df).collect())) == sorted(map(str, got))


def test_larger_budget_only_adds(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "s") for i in range(300)], "doc_id bigint, text string, source string")
    small = {r["doc_id"]: r["taken"] for r in mix_sources(df, budget=0.3).collect()}
    large = {r["doc_id"]: r["taken"] for r in mix_sources(df, budget=0.7).collect()}
    assert all(small[d] <= large[d] for d in small)


def test_empty_and_wordless_tables(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mix_sources(spark.createDataFrame([(1, None, None, None, None, None), (2, "", "a", None, None, None)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]
