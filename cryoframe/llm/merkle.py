"""Merkle manifest of a table of documents in a van Emde Boas layout (operator 11)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cryoframe.llm.common import ascii_lower, stored
from cryoframe.session import ship

#: Children of a node. Fixed by the task.
FANOUT = 8
#: A block is an aligned subtree of so many levels above its leaves, kept as one row: 4,681 digests of 32 bytes at most.
HEIGHT = 4
#: What a leaf covers, in this order. Fixed by the task.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


# --- the layout of one block ------------------------------------------------


def slots(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes (``depth`` below the root, ``index`` from the left) of a complete tree in van Emde Boas order.

    The tree is cut at half height: first the upper half as a tree of its own, then the lower subtrees from left to
    right, each laid out in the same way. Nothing but arithmetic is needed to find a node.
    """
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, span = levels - upper, FANOUT ** (depth - upper)
    return slots(upper) + index // span * slots(lower) + address(lower, depth - upper, index % span)


def height_of(n: int) -> int:
    """Levels above n nodes until one remains."""
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def level(nodes: np.ndarray, height: int, depth: int, n: int) -> str:
    """The n nodes of a level, left to right, as hex text."""
    return nodes[address(height + 1, depth, np.arange(n))].tobytes().hex()


def build(leaves: bytes, height: int) -> np.ndarray:
    """All nodes over the leaves (32 bytes each) in their places; places without a node hold zeros. The root stands first."""
    nodes = np.zeros((slots(height + 1), 32), np.uint8)
    n, row = len(leaves) // 32, leaves
    for depth in range(height, -1, -1):
        nodes[address(height + 1, depth, np.arange(n))] = np.frombuffer(row, np.uint8).reshape(n, 32)
        if depth:
            below = level(nodes, height, depth, n).encode()
            row = b"".join(sha256(below[k : k + 64 * FANOUT]) for k in range(0, len(below), 64 * FANOUT))
            n = len(row) // 32
    return nodes


def siblings(nodes: np.ndarray, height: int, n: int) -> list[list[tuple[str, str]]]:
    """For each of the n leaves, level by level: hex text of the siblings to the left and to the right in its run."""
    out: list[list[tuple[str, str]]] = [[] for _ in range(n)]
    for up, depth in enumerate(range(height, 0, -1)):
        text = level(nodes, height, depth, -(-n // FANOUT**up))
        for i, path in enumerate(out):
            k = i // FANOUT**up
            low, high = k // FANOUT * FANOUT * 64, (k // FANOUT + 1) * FANOUT * 64
            path.append((text[low : 64 * k], text[64 * k + 64 : high]))
    return out


def fold(digest: bytes, path: list[tuple[str, str]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        digest = sha256((left + digest.hex() + right).encode())
    return digest


# --- order ------------------------------------------------------------------


def _running(batches):
    """Rows of a sorted partition with ``start``: what ``m`` of the rows before them in the same tree comes to."""
    last, total = None, 0
    for batch in batches:
        tree, m = batch.column("tree"), np.asarray(batch.column("m"))
        if not len(m):
            continue
        goes_on = tree[0].as_py() == last
        changes = np.asarray(pc.not_equal(tree[1:], tree[:-1]))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], changes]), np.arange(len(m)), 0))
        before = np.cumsum(m) - m
        start = before - before[first] + np.where(first == 0, total if goes_on else 0, 0)
        last, total = tree[-1].as_py(), int(start[-1] + m[-1])
        yield batch.append_column("start", pa.array(start, pa.int64()))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, digest, m, ...) with ``at``, the place of the first of their m leaves in the tree, and ``n``, the leaves of the tree.

    A tree may hold any share of the rows: they are ordered by ranges, and only one sum a range and tree is looked at across ranges.
    """
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("part", F.spark_partition_id())
    schema = ordered.schema.simpleString()[len("struct<") : -1] + ",start:bigint"
    ordered = stored(ordered.mapInArrow(_running, schema))
    sums = ordered.groupBy("tree", "part").agg(F.sum("m").alias("size"))
    ranges = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("tree", "part", F.coalesce(F.sum("size").over(ranges), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy("tree")).alias("n"))
    return ordered.join(sums, ["tree", "part"]).withColumn("at", F.col("base") + F.col("start")).drop("part", "start", "base")


# --- tables -----------------------------------------------------------------


@dataclass
class Forest:
    """Trees over ordered leaves. ``tiers[0]`` holds the blocks next to the leaves, each further tier the blocks over the roots of the last one.

    A row of a tier: tree, block, n (nodes that the tier has in this tree), height, nodes (van Emde Boas order), root; in
    ``tiers[0]`` also ids and changed, which go with the leaves.
    """

    tiers: list[DataFrame]
    levels: int

    @property
    def block(self) -> int:
        """Leaves of a block."""
        return FANOUT**self.levels

    def roots(self) -> DataFrame:
        """tree, root."""
        return reduce(DataFrame.unionByName, [t.where(F.col("n") <= self.block).select("tree", "root") for t in self.tiers])


def _block(kind: str, levels: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        runs = np.asarray(table.column("run"))
        leaves = np.repeat(np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32), runs, axis=0)
        each = np.repeat(np.arange(len(runs)), runs)
        n = table.column("n")[0].as_py()
        height = min(levels, height_of(n))
        nodes = build(leaves.tobytes(), height)
        ids, changed = (pa.array([table.column(c).take(each).combine_chunks().to_pylist()], pa.list_(k)) for c, k in (("id", table.schema.field("id").type), ("changed", pa.binary())))
        return pa.table({"tree": table.column("tree")[:1], "block": table.column("block")[:1], "n": [n], "height": [height], "nodes": [nodes.tobytes()], "root": [nodes[0].tobytes()], "ids": ids, "changed": changed})

    return run, f"tree string, block bigint, n bigint, height bigint, nodes binary, root binary, ids array<{kind}>, changed array<binary>"


def _tier(rows: DataFrame, levels: int) -> DataFrame:
    """Blocks over rows (tree, at, m, n, digest, id, changed). A row of m equal leaves is cut at block borders, so it is never spread out before its block is built."""
    size = FANOUT**levels
    cut = rows.withColumn("block", F.explode(F.expr(f"sequence(at div {size}, (at + m - 1) div {size})")))
    low, high = F.greatest("at", F.col("block") * size), F.least(F.col("at") + F.col("m"), (F.col("block") + 1) * size)
    cut = cut.select("tree", "block", "n", (low - F.col("block") * size).alias("offset"), (high - low).alias("run"), "digest", "id", "changed")
    run, schema = _block(rows.schema["id"].dataType.simpleString(), levels)
    return stored(cut.groupBy("tree", "block").applyInArrow(run, schema))


def grow(leaves: DataFrame, levels: int = HEIGHT) -> Forest:
    """The forest over leaves (tree, at, m, n, digest, id, changed): blocks, then blocks over their roots, until each tree has one."""
    forest = Forest([_tier(leaves, levels)], levels)
    while (roots := forest.tiers[-1].where(F.col("n") > forest.block)).limit(1).count():
        up = roots.select("tree", F.col("block").alias("at"), F.lit(1).cast("bigint").alias("m"), F.expr(f"(n - 1) div {forest.block} + 1").alias("n"), F.col("root").alias("digest"))
        up = up.withColumn("id", F.lit(None).cast("bigint")).withColumn("changed", F.lit(None).cast("binary"))
        forest.tiers.append(_tier(up, levels).drop("ids", "changed"))
    return forest


def _leaves(row: dict) -> tuple[list[bytes], list[list[tuple[str, str]]]]:
    """Digests and whole paths of the nodes under a block, of a row that carries what lies above and how many leaves a whole block has."""
    nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32)
    n = min(row["size"], row["n"] - row["block"] * row["size"])
    above = [(x["left"], x["right"]) for x in row["path"]]
    digests = nodes[address(row["height"] + 1, row["height"], np.arange(n))]
    return [d.tobytes() for d in digests], [path + above for path in siblings(nodes, row["height"], n)]


PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
PATH_SQL = "array<struct<left:string,right:string>>"


def _descend(table: pa.Table) -> pa.Table:
    (row,) = table.to_pylist()
    _, paths = _leaves(row)
    first, n = row["block"] * row["size"], len(paths)
    paths = pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], PATH)
    return pa.table({"tree": [row["tree"]] * n, "block": pa.array(range(first, first + n), pa.int64()), "path": paths, "subroot": [row["subroot"]] * n, "top": [row["top"]] * n})


def _prove(table: pa.Table) -> pa.Table:
    (row,) = table.drop_columns(["ids"]).to_pylist()
    out = {k: [] for k in ("leaf", "proof_sha256", "folded_root")}
    for digest, path, changed in zip(*_leaves(row), row["changed"], strict=True):
        out["leaf"].append(digest.hex())
        out["proof_sha256"].append(hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest())
        out["folded_root"].append(fold(changed or digest, path).hex())
    n = len(out["leaf"])
    ids = table.column("ids").combine_chunks().flatten()
    return pa.table({"doc_id": ids, "leaf": out["leaf"], "subroot": [row["subroot"].hex()] * n, "root": [row["top"].hex()] * n, "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"]})


def paths_down(forest: Forest, above: DataFrame) -> DataFrame:
    """Blocks of ``tiers[0]`` with path, subroot and top, given those (tree, path, subroot, top) of each tree's root."""
    here = None
    for k in range(len(forest.tiers) - 1, -1, -1):
        tops = forest.tiers[k].where(F.col("n") <= forest.block).select("tree", "block").join(above, "tree")
        here = tops if here is None else here.unionByName(tops)
        blocks = forest.tiers[k].join(here, ["tree", "block"]).withColumn("size", F.lit(forest.block))
        if k:
            here = blocks.groupBy("tree", "block").applyInArrow(_descend, f"tree string, block bigint, path {PATH_SQL}, subroot binary, top binary")
    return blocks


@dataclass
class Manifest:
    """A forest with a tree for each language, and one tree over their roots."""

    languages: Forest
    whole: Forest

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root of every leaf, where folding starts from its changed digest if it has one."""
        top = self.whole.roots().select("tree", F.array().cast(PATH_SQL).alias("path"), F.col("root").alias("subroot"), F.col("root").alias("top"))
        under = paths_down(self.whole, top).drop("changed")
        named = under.groupBy("tree", "block").applyInArrow(_name_paths, f"tree string, path {PATH_SQL}, subroot binary, top binary")
        kind = self.languages.tiers[0].schema["ids"].dataType.elementType.simpleString()
        return paths_down(self.languages, named).groupBy("tree", "block").applyInArrow(
            _prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        )


def _name_paths(table: pa.Table) -> pa.Table:
    """Leaves of the tree over the languages: their names are trees in turn."""
    (row,) = table.to_pylist()
    digests, paths = _leaves(row)
    paths = pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], PATH)
    return pa.table({"tree": row["ids"], "path": paths, "subroot": digests, "top": [row["top"]] * len(digests)})


def leaf(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each as its UTF-8 byte count, a colon and its value; a null is a hyphen."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def manifest(docs: DataFrame, levels: int = HEIGHT) -> Manifest:
    """Builds the manifest of ``docs``; a row whose doc_id has a CRC-32 that 3 divides carries the digest of its tampered text along."""
    plain = [F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.unhex(leaf([*plain[:-1], ascii_lower(F.col("text").cast("string"))])))
    # One bytewise order for all languages, null first.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.unhex(leaf(plain)).alias("digest"), F.col("doc_id").alias("id"), tampered.alias("changed"))
    rows = rows.groupBy("tree", "id", "digest", "changed").agg(F.count(F.lit(1)).alias("m"))
    languages = grow(placed(stored(rows), ["id", "digest"]), levels)
    tops = languages.roots().select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("id"), F.lit(None).cast("binary").alias("changed"), F.lit(1).cast("bigint").alias("m"))
    return Manifest(languages, grow(placed(stored(tops), ["id"]), levels))


def report(docs: DataFrame, levels: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    Leaves of a language ascend by doc_id (null first), rows of one doc_id by digest; rows equal in all fields are leaves
    of their own beside each other. Null and empty texts differ: ``-`` and ``0:``. A language of one row has its leaf as
    root and an empty proof. A row without doc_id is not tampered with. Other columns are not covered. An empty table
    gives an empty report.
    """
    ship(docs.sparkSession)
    return manifest(docs, levels).proofs().withColumn("verified", F.col("folded_root") == F.col("root"))
