"""Digests that many tasks build together, whatever the split of the work."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from booklog.functions.text import evaluate_once

# Digests that one node of a tree holds, and the levels that a tree always has.
FAN = 1024
LEVELS = 3

_WORDS = 8


def content_digests(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """``keys, rows, digest`` of the rows of each key, as a multiset of ``content``.

    The SHA-256 of every content is read as eight numbers, and these are added up before the
    shuffle, which therefore carries one row per key and task. Order does not count: contents
    that must keep a place name it. A repeated row changes the sums. Sums tell accidental
    changes apart as well as a plain SHA-256 does, but not what someone forges on purpose.
    A key may have 2^31 rows; more end in an overflow error. Null content is an error.
    """
    known = F.coalesce(content, F.raise_error(F.lit("null has no digest")).cast("string"))
    hashed = evaluate_once(rows.select(*keys, known.alias("content")), "sha", F.sha2("content", 256))
    words = [f"word_{i}" for i in range(_WORDS)]
    sums = [
        F.sum(F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long")).alias(word)
        for i, word in enumerate(words)
    ]
    added = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *sums)
    return added.select(*keys, "rows", F.sha2(F.concat_ws(",", "rows", *words), 256).alias("digest"))


def tree_roots(digests: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rows, digest``: the root over each key's digests in order of ``number``, rows summed.

    A node is the SHA-256 of the hexadecimal digests of up to 1,024 neighbours, so no task
    holds more than that of one key, up to 2^30 digests.
    """
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "digest"))), lambda x: x["digest"]), ""
    )
    for level in range(1, LEVELS + 1):
        parent = F.floor(F.col("number") / F.lit(FAN)) if level < LEVELS else F.lit(0)
        placed = digests.select(*keys, parent.alias("parent"), "number", "rows", "digest")
        nodes = placed.groupBy(*keys, "parent").agg(
            F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("digest")
        )
        digests = nodes.withColumnRenamed("parent", "number")
    return digests.select(*keys, "rows", "digest")
