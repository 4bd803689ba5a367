"""Greedy string tiling against a plain version, and whole jobs on planted passages."""

import random

import numpy as np
from pyspark.sql import types as T

from intentlane.llm.decontaminate import coverage, leaks, remove_leaks
from intentlane.session import ship_package


def brute_tiles(item, runs, least):
    flat, free_r = [], []
    for r in runs:
        flat += [*r, None]
        free_r += [True] * len(r) + [False]
    free_i = [True] * len(item)
    tiles = []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(flat)):
                n = 0
                while (i + n < len(item) and j + n < len(flat) and free_i[i + n] and free_r[j + n] and item[i + n] == flat[j + n]):
                    n += 1
                if n >= least:
                    best.append((n, i, j))
        if not best:
            return tiles
        longest = max(b[0] for b in best)
        for n, i, j in best:
            if n == longest and all(free_i[i:i + n]) and all(free_r[j:j + n]):
                free_i[i:i + n] = [False] * n
                free_r[j:j + n] = [False] * n
                tiles.append((i, n))


def test_tiling_matches_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        item = [rnd.randint(1, 4) for _ in range(rnd.randint(1, 25))]
        runs = [[rnd.randint(1, 4) for _ in range(rnd.randint(1, 20))] for _ in range(rnd.randint(0, 3))]
        if runs and rnd.random() < 0.5:
            runs.append(item[len(item) // 2:] + item[:len(item) // 2])
        least = min(3, len(item))
        want = brute_tiles(item, runs, least)
        share, n, longest = coverage(np.array(item, np.uint64), [np.array(r, np.uint64) for r in runs], 3)
        assert share == sum(x for _, x in want) / len(item)
        assert (n, longest) == (len(want), max((x for _, x in want), default=0))


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("item_id", T.StringType()), T.StructField("key", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("coverage", T.StringType())])


def tables(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage = lambda n: " ".join(word() for _ in range(n))
    items = [(i, passage(40), None) for i in range(5)] + [(5, "Three short words", None), (6, None, None), (7, " ", None),
                                                         (None, passage(30), None), (0, None, None)]
    whole = lambda i: items[i][1]
    w = whole(2).split()
    docs = [(1, passage(50) + " " + whole(0).upper() + "! " + passage(20), None, None),     # other case, punctuation
            (2, passage(10) + "\n" + " ".join(w[20:] + ["x"] + w[:20]), None, None),         # reordered
            (3, passage(60) + " " + " ".join(whole(1).split()[:12]), None, None),            # 30 %: below the limit
            (4, passage(300), None, None), (5, None, None, None), (6, "", None, None),
            (7, "so, three short-words it is", None, None), (None, whole(3), None, None),
            (8, items[8][1], None, None), (9, "filler " * 30000 + whole(4) + " filler" * 10, None, None),
            (1, passage(5), None, None)]
    docs += [(100 + i, docs[0][1], None, None) for i in range(30)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)


def test_planted_passages(spark):
    ship_package(spark)
    docs, items = tables(spark)
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()}
    assert got == {(1, 0), (2, 2), (7, 5), (None, 3), (8, None), (9, 4)} | {(100 + i, 0) for i in range(30)}
    kept = remove_leaks(docs, items)
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in kept.collect())[0][0] == 1  # the clean row of that id stays
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6]
    assert kept.columns == docs.columns


def test_empty_tables(spark):
    ship_package(spark)
    docs, items = tables(spark)
    assert leaks(docs.limit(0), items).count() == 0
    assert leaks(docs, items.limit(0)).count() == 0
    assert remove_leaks(docs, items.limit(0)).count() == docs.count()
