"""Merkle manifest of a table, its trees kept in van Emde Boas layout.

Every row is a leaf; the leaves of a group (a language) ascend by id and form a
tree in which eight consecutive nodes become one. A tree is cut into aligned
blocks of up to ``8 ** BLOCK_HEIGHT`` leaves. The nodes of a block lie in one
array: the upper half of the block's levels first, then each subtree below it,
each laid out likewise, so that a walk from a leaf to the block's root meets
few places at any cache size. ``veb_address`` gives the place of a node from
its level and index alone; the tree has no pointers. Blocks are built by one
task each, their roots are the leaves of the next round's blocks, and the roots
of the groups form a tree of the same kind. Proofs go the other way: from the
last block down, every block hands its members the siblings on their way up.
A group that holds most rows is many blocks and so many tasks.

Nulls: a null field is ``-`` in the leaf, a null group comes first, null ids
come first in their group. Rows that share an id are ordered by leaf; equal
rows are equal leaves side by side. An empty or null text is a field like any
other, a very long one is hashed whole, once. An empty table has no leaf and
gives no row. Other columns, also of the names used here, are ignored."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.llm.common import materialise, table
from intentlane.llm.ordering import positions

FAN = 8
BLOCK_HEIGHT = 4          # 4096 leaves a block
SHIFT = 3 * BLOCK_HEIGHT
DIGEST = 32               # bytes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hash_hex(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def complete(levels: int) -> int:
    """Nodes of a complete tree of that many levels."""
    return (FAN ** levels - 1) // (FAN - 1)


def veb_address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of one depth (0: the root) in the van Emde
    Boas layout of a complete tree. A tree that lacks its last leaves uses the
    same places and ends early."""
    if levels == 1:
        return np.zeros(len(index), np.int64)
    top = levels // 2
    if depth < top:
        return veb_address(top, depth, index)
    below = levels - top
    tree, inside = np.divmod(index, FAN ** (depth - top))
    return complete(top) + tree * complete(below) + veb_address(below, depth - top, inside)


def height_for(leaves: int) -> int:
    height = 0
    while FAN ** height < leaves:
        height += 1
    return height


@functools.lru_cache(maxsize=64)
def _level_places(height: int, level: int, count: int) -> np.ndarray:
    return veb_address(height + 1, height - level, np.arange(count, dtype=np.int64))


class Block:
    """An aligned subtree: ``nodes`` are its digests in van Emde Boas order."""

    def __init__(self, nodes: np.ndarray, height: int, leaves: int):
        self.nodes, self.height, self.leaves = nodes, height, leaves

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        counts = [len(leaves)]
        for _ in range(height):
            counts.append(-(-counts[-1] // FAN))
        places = [_level_places(height, level, n) for level, n in enumerate(counts)]
        out = cls(np.zeros((1 + max(int(p.max()) for p in places), DIGEST), np.uint8), height, len(leaves))
        out.nodes[places[0]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, DIGEST)
        for level in range(height):
            for run, place in enumerate(places[level + 1]):
                digest = sha256(out.run(level, run).encode()).digest()
                out.nodes[place] = np.frombuffer(digest, np.uint8)
        return out

    def count(self, level: int) -> int:
        return -(-self.leaves // FAN ** level)

    def run(self, level: int, run: int) -> str:
        """The digests of one run of siblings, as one hex text."""
        first = run * FAN
        past = min(first + FAN, self.count(level))
        at = veb_address(self.height + 1, self.height - level, np.arange(first, past, dtype=np.int64))
        return self.nodes[at].tobytes().hex()

    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def runs(self, level: int) -> list[str]:
        """All runs of a level."""
        n = self.count(level)
        text = self.nodes[_level_places(self.height, level, n)].tobytes().hex()
        width = 2 * DIGEST * FAN
        return [text[k:k + width] for k in range(0, len(text), width)]

    def ways(self) -> list[list[str]]:
        """Runs of every level, from the leaves up; the way of leaf i passes
        run i // 8 of the first level, then i // 64 of the second ..."""
        return [self.runs(level) for level in range(self.height)]


def sides(runs: list[str], index: int) -> tuple[str, str]:
    """The siblings left and right of a node, each as one hex text."""
    run, at = runs[index // FAN], 2 * DIGEST * (index % FAN)
    return run[:at], run[at + 2 * DIGEST:]


def fold(node: str, way: list[tuple[str, str]]) -> str:
    for left, right in way:
        node = hash_hex(left + node + right)
    return node


BLOCK_TYPE = ("g string, block bigint, total bigint, height int, nodes binary, root binary")


def _build(with_extra: bool, id_type: pa.DataType):
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        total = rows["total"][0].as_py()
        height = BLOCK_HEIGHT if total > FAN ** BLOCK_HEIGHT else height_for(total)
        block = Block.build(rows["leaf"].to_pylist(), height)
        out = {"g": rows["g"].slice(0, 1), "block": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([total], pa.int64()),
               "height": pa.array([height], pa.int32()), "nodes": pa.array([block.nodes.tobytes()], pa.binary()),
               "root": pa.array([block.root()], pa.binary()),
               "ids": pa.array([rows["id"].to_pylist()], pa.list_(id_type))}
        if with_extra:
            out["other"] = pa.array([rows["other"].to_pylist()], pa.list_(pa.binary()))
        return pa.table(out)
    return build


def build_levels(leaves: DataFrame, order: list[str], name: str) -> list[DataFrame]:
    """The block tables of the trees of all groups, from the leaves up.

    ``leaves`` has ``g`` (a non-null group key), ``id``, ``leaf`` (binary) and,
    if wanted, ``other`` (a binary that goes along). The number of rounds is
    the logarithm of the largest group to the base 4096."""
    placed = positions(leaves, "g", order, f"{name}-leaves")
    levels: list[DataFrame] = []
    while True:
        extra = "other" in placed.columns
        id_field = placed.schema["id"]
        kind = id_field.dataType.simpleString()
        id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        if id_type == pa.string() and kind != "string":
            raise ValueError(f"ids must be int, bigint or string, not {kind}")
        schema = f"{BLOCK_TYPE}, ids array<{kind}>" + (", other array<binary>" if extra else "")
        blocks = materialise(
            placed.withColumn("block", F.shiftright("pos", SHIFT)).groupBy("g", "block")
            .applyInArrow(_build(extra, id_type), schema), f"{name}-blocks")
        levels.append(blocks)
        most = blocks.agg(F.max("total")).first()[0]
        if most is None or most <= FAN ** BLOCK_HEIGHT:
            return levels
        # the block roots of the groups that have several blocks are the next leaves
        placed = (blocks.where(F.col("total") > FAN ** BLOCK_HEIGHT)
                  .select("g", F.col("block").alias("id"), F.col("root").alias("leaf"), F.col("block").alias("pos"),
                          F.shiftright(F.col("total") + (FAN ** BLOCK_HEIGHT - 1), SHIFT).alias("total")))


def group_roots(levels: list[DataFrame]) -> DataFrame:
    """(g, root), one row per group."""
    tops = [b.where(F.col("total") <= FAN ** BLOCK_HEIGHT).select("g", "root") for b in levels]
    return functools.reduce(DataFrame.unionByName, tops)


def _open(batch: pa.RecordBatch, i: int) -> Block:
    ids = batch["ids"][i]
    nodes = np.frombuffer(batch["nodes"][i].as_py(), np.uint8).reshape(-1, DIGEST)
    return Block(nodes, batch["height"][i].as_py(), len(ids))


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every block's members with their way to the root: siblings inside the block, then the block's own way."""
    for batch in batches:
        for i in range(batch.num_rows):
            ways = _open(batch, i).ways()
            up_left, up_right = batch["lefts"][i].as_py(), batch["rights"][i].as_py()
            members = batch["ids"][i].values
            lefts, rights = [], []
            for k in range(len(members)):
                way = [sides(runs, k // FAN ** level) for level, runs in enumerate(ways)]
                lefts.append([a for a, _ in way] + up_left)
                rights.append([b for _, b in way] + up_right)
            again = pa.array([i] * len(members), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["g"].take(again), members, pa.array(lefts, pa.list_(pa.string())), pa.array(rights, pa.list_(pa.string())),
                 batch["subroot"].take(again), batch["top"].take(again)],
                names=["g", "member", "lefts", "rights", "subroot", "top"])


WAY = "lefts array<string>, rights array<string>, subroot string, top string"


def hand_down(levels: list[DataFrame], start: DataFrame, name: str) -> DataFrame:
    """The leaf blocks with their way to the root. ``start`` has one row per
    group: ``g`` and its root's own way (``lefts``, ``rights``) and roots
    (``subroot``, ``top``)."""
    way_cols = ["lefts", "rights", "subroot", "top"]
    below = None
    for n, blocks in reversed(list(enumerate(levels))):
        tops = blocks.where(F.col("total") <= FAN ** BLOCK_HEIGHT).select("g", "block")
        ways = tops.join(start, "g").select("g", "block", *way_cols)
        if below is not None:
            ways = ways.unionByName(below)
        opened = blocks.join(ways, ["g", "block"])
        if n == 0:
            return opened
        below = materialise(
            opened.select("g", "height", "nodes", "ids", *way_cols)
            .mapInArrow(_hand_down, f"g string, member bigint, {WAY}")
            .withColumnRenamed("member", "block"), f"{name}-ways")


def _prove(id_type: pa.DataType):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _open(batch, i)
                ways = block.ways()
                leaves = block.nodes[_level_places(block.height, 0, block.leaves)].tobytes().hex()
                up = list(zip(batch["lefts"][i].as_py(), batch["rights"][i].as_py()))
                up_text = "".join(a + b for a, b in up)
                others = batch["other"][i].as_py()
                own, proofs, folded = [], [], []
                for k in range(block.leaves):
                    way = [sides(runs, k // FAN ** level) for level, runs in enumerate(ways)]
                    leaf = leaves[2 * DIGEST * k:2 * DIGEST * (k + 1)]
                    own.append(leaf)
                    proofs.append(hash_hex("".join([a + b for a, b in way]) + up_text))
                    folded.append(fold(leaf if others[k] is None else others[k].hex(), way + up))
                again = pa.array([i] * block.leaves, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch["ids"][i].values.cast(id_type), pa.array(own, pa.string()), batch["subroot"].take(again), batch["top"].take(again),
                     pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])
    return prove


@dataclass
class Manifest:
    """Block tables of the groups' trees and of the tree over the groups' roots."""
    levels: list[DataFrame]
    top_levels: list[DataFrame]

    def root(self) -> str | None:
        row = group_roots(self.top_levels).first()
        return row["root"].hex() if row else None

    def subroots(self) -> DataFrame:
        return group_roots(self.levels).select(
            F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("group"), F.lower(F.hex("root")).alias("subroot"))

    def prove(self, id_col: str = "id") -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every
        leaf; a leaf that has an ``other`` digest is folded from that one."""
        none = F.array().cast("array<string>")
        start = group_roots(self.top_levels).select("g", none.alias("lefts"), none.alias("rights"),
                                                    F.lit("").alias("subroot"), F.lower(F.hex("root")).alias("top"))
        tops = hand_down(self.top_levels, start, "manifest-top")
        ways = materialise(tops.select("g", "height", "nodes", "ids", "lefts", "rights", "subroot", "top")
                           .mapInArrow(_hand_down, f"g string, member string, {WAY}").drop("g", "subroot")
                           .withColumnRenamed("member", "g"), "manifest-group-ways")
        ways = ways.join(group_roots(self.levels), "g").withColumn("subroot", F.lower(F.hex("root"))).drop("root")
        opened = hand_down(self.levels, ways, "manifest")
        kind = opened.schema["ids"].dataType.elementType.simpleString()
        id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
        return (opened.select("height", "nodes", "ids", "other", "lefts", "rights", "subroot", "top")
                .mapInArrow(_prove(id_type), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
                .withColumn("verified", F.col("folded_root") == F.col("root"))
                .withColumnRenamed("id", id_col))


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def build_manifest(docs: DataFrame, fields: list[str] | None = None, id_col: str = "doc_id", group_col: str = "lang",
                   other: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The manifest of a table. ``other`` replaces fields of the rows ``where``
    holds: their digests go along as candidates that ``prove`` folds."""
    names = list(fields or FIELDS)
    own = leaf_digest([F.col(c) for c in names])
    if other:
        changed = leaf_digest([other.get(c, F.col(c)) for c in names])
        candidate = F.when(F.lit(True) if where is None else where, changed)
    else:
        candidate = F.lit(None).cast("binary")
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    leaves = materialise(docs.select(group.alias("g"), F.col(id_col).alias("id"), own.alias("leaf"), candidate.alias("other"),
                                     F.monotonically_increasing_id().alias("row")), "manifest-rows")
    levels = build_levels(leaves, ["id", "leaf", "row"], "manifest")
    tops = group_roots(levels).select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("root").alias("leaf"))
    return Manifest(levels, build_levels(materialise(tops, "manifest-subroots"), ["id"], "manifest-top"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    manifest = build_manifest(docs, other={"text": F.translate("text", UPPER, LOWER)}, where=tampered)
    return manifest.prove("doc_id").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
