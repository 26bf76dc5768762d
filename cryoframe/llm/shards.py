"""Sharding by a minimax contiguous partition (operator 3). DataFrame functions only; the driver holds a bounded number of cell sums."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cryoframe.llm.common import ids_and_texts
from cryoframe.session import cut

#: Order of the atomic groups: a hash of the text, so any range of it holds its share of groups. Equal texts share a key.
KEY_BITS = 60
#: Bits of a cell at first, and by how many more a cell in question is cut.
FIRST_BITS, MORE_BITS = 12, 4
#: A row costs so many bytes beside its text. Fixed by the task.
OVERHEAD = 16
#: Parts of a shard that are numbered apart.
BINS = 512


@dataclass
class Cell:
    """A range of keys: its first bits, the bytes and groups in it, and its largest group."""

    prefix: int
    bits: int
    size: int
    groups: int

    @property
    def first_key(self) -> int:
        return self.prefix << (KEY_BITS - self.bits)


class Line:
    """Cells in order of their keys, and where shards of a given capacity end, in bytes from the start.

    ``reach(x, c, whole)`` is how far a shard of capacity c goes from x: with ``whole`` to the end of a cell only (too
    short, unless cells are single groups), without it into any cell of several groups (too far, if anything).
    The true place lies between the two, and all are monotone in x and c.
    """

    def __init__(self, cells: list[Cell], shards: int):
        self.cells, self.shards = cells, shards
        self.ends = [0, *accumulate(c.size for c in cells)]
        self.total = self.ends[-1]

    def reach(self, x: int, capacity: int, whole: bool) -> int:
        k = bisect_right(self.ends, x + capacity) - 1
        if k >= len(self.cells):
            return self.total
        return x + capacity if not whole and self.cells[k].groups > 1 else max(x, self.ends[k])

    def places(self, capacity: int, whole: bool) -> list[int]:
        out = [0]
        for _ in range(self.shards):
            out.append(self.reach(out[-1], capacity, whole))
        return out[1:]

    def smallest(self, low: int, whole: bool) -> int:
        """The smallest capacity of at least ``low`` with which greedy shards reach the end."""
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.places(middle, whole)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def doubtful(self, least: int) -> tuple[int, list[int]]:
        """(capacity, numbers of cells of several groups that a shard may end in): with none in doubt, the capacity is exact."""
        low, high = self.smallest(least, whole=False), self.smallest(least, whole=True)
        inside = set()
        for a, b in zip(self.places(low, whole=True), self.places(high, whole=False), strict=True):
            i, j = bisect_right(self.ends, a) - 1, bisect_right(self.ends, b) - 1
            inside.update(k for k in range(max(0, i), min(j, len(self.cells) - 1) + 1) if self.cells[k].groups > 1 and b > self.ends[k])
        return high, sorted(inside)


def _cells(groups: DataFrame, bits: int) -> list[Cell]:
    prefix = F.shiftright("key", KEY_BITS - bits).alias("prefix")
    rows = groups.groupBy(prefix).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return [Cell(r.prefix, bits, r["size"], r.n) for r in rows]


def _refined(groups: DataFrame, cells: list[Cell]) -> list[Cell]:
    """The same key ranges in finer cells; one job for each width among them. Never more than some thousand cells at a time."""
    out = []
    for bits in sorted({c.bits for c in cells}):
        wanted = [(c.prefix,) for c in cells if c.bits == bits]
        asked = groups.sparkSession.createDataFrame(wanted, "prefix bigint")
        held = groups.withColumn("prefix", F.shiftright("key", KEY_BITS - bits)).join(F.broadcast(asked), "prefix", "left_semi")
        out += _cells(held, min(KEY_BITS, bits + MORE_BITS))
    return out


def boundaries(groups: DataFrame, shards: int) -> tuple[dict[int, int], list[int], int]:
    """(shards of giants by key, first keys of the shards after the first, capacity) for atomic groups (key, size).

    A group above the mean of the shards that are left has a shard of its own: no partition does with less than that
    group, and the others stay near equal. The others, in order of their keys, are cut by the smallest capacity for
    which greedy shards suffice, found by binary search over sums of cells; only cells that a cut may fall into are
    looked at more closely, until those are single groups.
    """
    stats = groups.agg(F.sum("size"), F.max("size")).first()
    rest, left, giants = stats[0] or 0, shards, []
    for key, size in [(r.key, r["size"]) for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect()]:
        if left > 1 and size * left > rest:
            giants.append((key, size))
            rest, left = rest - size, left - 1
        else:
            break
    own = {key: left + i for i, (key, _) in enumerate(giants)}
    others = groups.where(~F.col("key").isin(list(own))) if own else groups
    largest = others.agg(F.max("size")).first()[0]
    if largest is None:
        return own, [], 0
    cells = sorted(_cells(others, FIRST_BITS), key=lambda c: c.first_key)
    least = max(largest, -(-rest // left))
    while True:
        line = Line(cells, left)
        capacity, doubt = line.doubtful(least)
        if not doubt:
            break
        finer = _refined(others, [cells[k] for k in doubt])
        kept = [c for k, c in enumerate(cells) if k not in set(doubt)]
        cells = sorted(kept + finer, key=lambda c: c.first_key)
    cuts = [x for x in line.places(capacity, whole=True)[:-1] if x < line.total]
    return own, [line.cells[bisect_right(line.ends, x) - 1].first_key for x in cuts], max([capacity, *(s for _, s in giants)])


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``: law ``bytes``.

    Size is the text's UTF-8 bytes plus 16; null counts as empty. Equal texts are one atomic group and share a shard.
    Slots number the rows of a shard from 0 without gaps, in order of a hash of doc_id, then doc_id; rows alike in all
    columns may swap slots. grown_shard is null. With fewer groups than shards, some shards are empty; so is the result
    of an empty table.
    """
    docs = ids_and_texts(docs)
    text = F.coalesce("text", F.lit(""))
    keyed = cut(
        docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key"))
    )
    groups = cut(keyed.groupBy("key").agg(F.sum("size").alias("size")))
    own, firsts, _ = boundaries(groups, shards)
    shard = sum([(F.col("key") >= k).cast("int") for k in firsts], F.lit(0))
    for key, number in own.items():
        shard = F.when(F.col("key") == key, F.lit(number)).otherwise(shard)
    placed = keyed.withColumn("shard", shard).withColumn("bin", F.pmod(F.xxhash64("doc_id"), F.lit(BINS)).cast("int"))
    # Numbered by small parts of each shard; then each part begins where the parts before it end.
    sizes = placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("before"))
    in_part = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "key", "size"))
    return placed.withColumn("in_part", in_part).join(offsets, ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("in_part") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
