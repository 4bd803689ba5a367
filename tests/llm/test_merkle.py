"""Merkle manifest against plain trees, and its layout against the definition."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from intentlane.llm import merkle
from intentlane.llm.merkle import Block, build_manifest, complete, fold, hash_hex, sides, veb_address
from intentlane.llm.ordering import positions
from intentlane.session import ship_package

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("g", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("leaf", T.StringType()),
                       T.StructField("block", T.StringType()), T.StructField("_mid", T.StringType())])


def layout(levels):
    """(depth, index) in van Emde Boas order, straight from the definition."""
    if levels == 1:
        return [(0, 0)]
    top = levels // 2
    out = list(layout(top))
    for tree in range(8 ** top):
        out += [(top + d, tree * 8 ** d + i) for d, i in layout(levels - top)]
    return out


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_address_is_the_layout(levels):
    at = {node: k for k, node in enumerate(layout(levels))}
    assert len(at) == complete(levels)
    for depth in range(levels):
        index = np.arange(8 ** depth)
        assert veb_address(levels, depth, index).tolist() == [at[depth, int(i)] for i in index]


@pytest.mark.parametrize("leaves,height", [(1, 0), (1, 4), (8, 1), (9, 2), (65, 4), (700, 4), (4096, 4)])
def test_block_folds_to_its_root(leaves, height):
    own = [sha256(b"%d" % i).digest() for i in range(leaves)]
    block = Block.build(own, height)
    level = [x.hex() for x in own]
    for _ in range(height):
        level = [hash_hex("".join(level[k:k + 8])) for k in range(0, len(level), 8)]
    assert level == [block.root().hex()]
    assert len(block.nodes) <= complete(height + 1)
    ways = block.ways()
    for i in {0, leaves // 2, leaves - 1}:
        way = [sides(runs, i // 8 ** k) for k, runs in enumerate(ways)]
        assert fold(own[i].hex(), way) == block.root().hex()
        assert leaves == 1 or fold(hash_hex("x"), way) != block.root().hex()


def brute(rows):
    """The contract's rows, by plain lists."""
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return hash_hex("".join(enc(v) for v in (*r[:4], text)))

    def crc(i):
        return zlib.crc32(str(i).encode())

    groups = {}
    for r in rows:
        text = r[4]
        if r[0] is not None and crc(r[0]) % 3 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(r[2], []).append((r[0], leaf(r, r[4]), leaf(r, text)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([hash_hex("".join(levels[-1][k:k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, i):
        out = []
        for level in levels[:-1]:
            run = i // 8 * 8
            out.append(("".join(level[run:i]), "".join(level[i + 1:run + 8])))
            i //= 8
        return out

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([x[1] for x in groups[g]])
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, (doc, own, other) in enumerate(groups[g]):
            full = way(trees[g], i) + way(top, n)
            folded = fold(other, full)
            out.append((doc, own, trees[g][-1][0], top[-1][0], hash_hex("".join(a + b for a, b in full)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def op12(docs):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    manifest = build_manifest(docs, other={"text": F.translate("text", merkle.UPPER, merkle.LOWER)}, where=tampered)
    return manifest, sorted(map(tuple, manifest.prove("doc_id").collect()), key=repr)


def rows_of(n, langs, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        text = rnd.choice([None, "", "lower only", "Mixed Ünïcode TEXT " * rnd.randrange(4), "A" * 3000])
        out.append((i if rnd.random() > 0.03 else None, rnd.choice(["a", None, "web"]), rnd.choice(langs), rnd.choice([None, 0, 12]), text, "c", "c", "c", "c", "c"))
    return out


def test_manifest_equals_plain_trees(spark):
    ship_package(spark)
    rows = rows_of(900, ["en", None, "", "é", "de", "only-one"] + ["en"] * 6)
    rows += rows[:40] + [rows[3]] * 30 + [(7, "a", "de", 1, "Other", *["c"] * 5)]     # repeated rows and ids
    manifest, got = op12(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert manifest.root() == got[0][3]
    assert {(r["group"], r["subroot"]) for r in manifest.subroots().collect()} == {(r[2], x[2]) for r in rows for x in got if x[1] == hash_hex(
        "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))}


def test_blocks_of_blocks(spark, monkeypatch):
    """Groups of several rounds: with blocks of 8 leaves, 700 leaves take four."""
    ship_package(spark)
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", 1)
    monkeypatch.setattr(merkle, "SHIFT", 3)
    rows = rows_of(700, ["en"] * 8 + ["de"] + [f"l{i}" for i in range(5)])
    docs = spark.createDataFrame(rows, SCHEMA)
    levels = []
    original = merkle.build_levels

    def build_levels(*args):
        levels.append(original(*args))
        return levels[-1]

    monkeypatch.setattr(merkle, "_build", _build_one_level)
    monkeypatch.setattr(merkle, "build_levels", build_levels)
    assert op12(docs)[1] == brute(rows)
    assert len(levels[0]) >= 3 and len(levels[1]) == 1


def _build_one_level(with_extra, id_type):
    import pyarrow as pa

    def build(key, rows):
        from intentlane.llm.merkle import Block, height_for
        rows = rows.sort_by("pos")
        total = rows["total"][0].as_py()
        height = 1 if total > 8 else height_for(total)
        block = Block.build(rows["leaf"].to_pylist(), height)
        out = {"g": rows["g"].slice(0, 1), "block": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([total], pa.int64()),
               "height": pa.array([height], pa.int32()), "nodes": pa.array([block.nodes.tobytes()], pa.binary()),
               "root": pa.array([block.root()], pa.binary()), "ids": pa.array([rows["id"].to_pylist()], pa.list_(id_type))}
        if with_extra:
            out["other"] = pa.array([rows["other"].to_pylist()], pa.list_(pa.binary()))
        return pa.table(out)
    return build


def test_empty_and_single(spark):
    ship_package(spark)
    empty = spark.createDataFrame([], SCHEMA)
    manifest, got = op12(empty)
    assert got == [] and manifest.root() is None
    one = [(4, None, None, None, None, *["c"] * 5)]
    assert op12(spark.createDataFrame(one, SCHEMA))[1] == brute(one)


def test_positions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abbbbbbb"), rnd.randrange(50), i) for i in range(2000)]
    got = positions(spark.createDataFrame(rows, "g string, a int, b int"), "g", ["a", "b"], "test-positions").collect()
    for g in "ab":
        mine = sorted((r["pos"], r["a"], r["b"], r["total"]) for r in got if r["g"] == g)
        want = sorted((a, b) for x, a, b in rows if x == g)
        assert mine == [(k, a, b, len(want)) for k, (a, b) in enumerate(want)]
