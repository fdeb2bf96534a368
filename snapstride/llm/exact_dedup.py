"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text becomes the ordered list of its chunks' identifiers. Chunk borders depend on
nearby characters only, so texts that share passages share chunks. Each distinct chunk
crosses the network once, to prove that no two chunks share an identifier; after that,
documents are compared by their identifier lists and their texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: About half of the characters of usual text, in lower case; more scripts by half ranges.
HALF = r"[ \n,aeilnsduw13579\u00e0-\u00ef\u0430-\u043f\u4e00-\u6fff]"

#: A chunk has 256 to 4096 code points and ends between four characters of HALF and four
#: more, about one place in two hundred; without such a place it ends at 4096, or with the text.
CHUNK = rf"(?s).{{256,4096}}?(?<={HALF}{{4}})(?={HALF}{{4}})|.{{1,4096}}"

#: Tried in this order until one is proven free of collisions on the given chunks: 128 bits
#: from two hashes of different seeds (of 10**12 chunks two collide with a chance of 10**-14;
#: with 64 bits some do from billions on), then 256 bits.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (
    lambda chunk: F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b")),
    lambda chunk: F.unhex(F.sha2(chunk, 256)),
)


def fold_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def injective(folded: DataFrame, ident: Callable[[Column], Column], pattern: str = CHUNK) -> bool:
    """Whether ``ident`` gives each distinct chunk of ``folded.text`` a value of its own."""
    store = folded.select(F.explode(chunks(F.col("text"), pattern)).alias("chunk"))
    store = store.select(ident(F.col("chunk")).alias("id"), "chunk").distinct()
    return store.groupBy("id").count().filter("count > 1").count() == 0


def verified(
    folded: DataFrame,
    identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS,
    pattern: str = CHUNK,
) -> Callable[[Column], Column]:
    """The first of ``identifiers`` under which equal ids mean equal chunks."""
    for ident in identifiers:
        if injective(folded, ident, pattern):
            return ident
    raise ValueError("every identifier maps two different chunks to one value")


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS,
    pattern: str = CHUNK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after A-Z are lowered. Of equal texts the largest
    ``doc_id`` stays. Defined cases: a null text counts as empty, and all empty texts are
    one group; rows that repeat a doc_id and its text are counted one by one and share
    ``kept``; a null doc_id never wins over another and is kept only in a group of nulls;
    an empty table gives no rows; other columns of ``docs`` are not read.
    """
    folded = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("text"))
    ident = verified(folded, identifiers, pattern)
    recipes = staged(
        folded.select(
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform(chunks(F.col("text"), pattern), ident).alias("recipe"),
        ),
        "recipes",
    )
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("rows"))
    # written apart, so that both sides of the join are dealt anew and a hot group can be split
    groups = staged(groups.filter("rows > 1"), "copies")
    found = recipes.join(groups, "recipe", "left")
    keep = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
