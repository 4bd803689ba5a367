"""Spelling variants against edit distances of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from intentlane.llm.spelling import group_variants, runs_of, vocabulary
from intentlane.session import ship_package

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType()),
                       T.StructField("n", T.StringType()), T.StructField("key", T.StringType()), T.StructField("_id", T.StringType())])


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute_groups(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if is_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v)) if near else None
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def brute_words(rows, slips):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slips and h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def result(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def word(rnd, letters, length):
    return "".join(rnd.choice(letters) for _ in range(length))


@pytest.mark.parametrize("tile_words", [4096, 16])
def test_all_pairs(spark, tile_words):
    """Dense words over few letters; with small tiles most keys are cut into blocks."""
    ship_package(spark)
    rnd = random.Random(tile_words)
    words = {word(rnd, "abé", rnd.choice([1, 2, 5, 6, 7, 8, 9])) for _ in range(900)}
    words |= {word(rnd, "xyzÿ\U0001f600", 12) for _ in range(50)} | {"q" * 60, "q" * 61, "q" * 59 + "r", "aaaaa", "aaaaaa"}
    counts = {w: rnd.choice([3, 3, 4, 8, 17, 40]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(7)
    assert result(group_variants(df, tile_words=tile_words)) == brute_groups(counts)


def test_words_of_documents(spark):
    ship_package(spark)
    rnd = random.Random(2)
    base = [word(rnd, "abcdeÀß", rnd.choice([3, 5, 6, 8, 30])) for _ in range(120)]
    rows = [(i if i % 9 else None, rnd.choice([" ", "-", "1", "\n"]).join(rnd.choice(base).capitalize() for _ in range(60)), "c", "c", "c", "c")
            for i in range(150)]
    rows += [(500, None, "c", "c", "c", "c"), (501, "", None, None, None, None), (None, "123 -- ", "c", "c", "c", "c")]
    rows += [(502, "common " * 50_000 + "w" * 200_000 + " " + "w" * 200_000 + " " + "w" * 199_999 + "v" + " " + ("w" * 200_000 + " ") * 2
              + ("w" * 199_999 + "v ") * 3, "c", "c", "c", "c")]
    rows += rows[:5]
    for slips in (97, 7, None):
        counts = brute_words(rows, slips)
        got = {r["word"]: r["n"] for r in vocabulary(runs_of(spark.createDataFrame(rows, SCHEMA), slips=slips)).collect()}
        assert got == counts
    df = vocabulary(runs_of(spark.createDataFrame(rows, SCHEMA), slips=7))
    assert result(group_variants(df)) == brute_groups(brute_words(rows, 7))


def test_chains_and_empty(spark):
    ship_package(spark)
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbb": 191, "zzzzz": 5, "zzzzy": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = result(group_variants(df))
    assert got == brute_groups(counts)
    assert {r[0]: r[2] for r in got}["aaaaa"] == "bbbbb"
    assert result(group_variants(vocabulary(runs_of(spark.createDataFrame([], SCHEMA))))) == set()
