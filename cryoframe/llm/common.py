"""What several operators share: reading texts in tasks, safe places to cut a text, connected components."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryoframe.session import checkpoint_dir, cut, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator needs, under fixed names; whatever else ``docs`` holds is left behind."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def stored(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` bears."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


#: Whose tables this Python worker holds, and how to let go of them.
_holder: list = ["", None]


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """A worker is used again by other operators; the one that starts a task makes the last one's tables go."""
    if _holder[0] != owner:
        if _holder[1] is not None:
            _holder[1]()
            gc.collect()
        _holder[:] = [owner, release]


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def pieces(text: str, most: int) -> Iterator[str]:
    """``text`` in pieces of about ``most`` characters, cut only before a space or line end that follows a visible character.

    No match of the usual pre-tokenizer patterns spans such a place, so tokens of the pieces are the tokens of the text.
    A stretch without such a place stays whole.
    """
    at, n = 0, len(text)
    while n - at > most:
        end = _place_before(text, at + 1, at + most) or _place_after(text, at + most)
        if not end:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _place_before(text: str, low: int, high: int) -> int:
    while (i := max(text.rfind(" ", low, high), text.rfind("\n", low, high))) > 0:
        if not text[i - 1].isspace():
            return i
        high = i
    return 0


def _place_after(text: str, low: int) -> int:
    for i in range(low, len(text)):
        if text[i] in " \n" and not text[i - 1].isspace():
            return i
    return 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node that can be reached.

    Alternating large and small stars: each round hangs neighbours on the smallest one, so paths shrink by halves.
    Edges stay a table; every round is checkpointed. Only a count and a checksum come to the driver.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        near = both(links)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        links = cut(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
