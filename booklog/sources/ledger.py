"""The commit ledger: a snapshot of old entries and a short tail of new ones.

An entry is a folder of its own below ``commits`` until the tail has ``TAIL_BATCHES`` of them.
Then all entries move into a new version of the snapshot, which also keeps the closed ranges of
batch ids that it holds. Batches are numbered one after the other, so the ranges are few, and
what the driver reads does not grow with the number of batches.
"""

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.config import Store
from booklog.schema import BATCH_COMMIT
from booklog.sources import storage

TAIL_BATCHES = 100
_ENTRY = re.compile(r"(batch_id|hidden)=([0-9]+)")

Ranges = list[tuple[int, int]]


@dataclass(frozen=True)
class Ledger:
    """Where the snapshot lies, its ranges, and what the tail adds and hides."""

    folder: str | None
    ranges: Ranges
    tail: list[int]
    hidden: list[int]

    def visible(self) -> Ranges:
        return joined(without(self.ranges, self.hidden) + [(x, x) for x in self.tail])

    def replaced(self) -> list[int]:
        """Ids whose rows in the snapshot no longer hold."""
        return sorted({*self.tail, *self.hidden})


def joined(ranges: Ranges) -> Ranges:
    """The same ids in the fewest ranges."""
    found: Ranges = []
    for low, high in sorted(ranges):
        if found and low <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(high, found[-1][1]))
        else:
            found.append((low, high))
    return found


def without(ranges: Ranges, ids: list[int]) -> Ranges:
    for gone in ids:
        cut = [part for low, high in ranges for part in ((low, min(high, gone - 1)), (max(low, gone + 1), high))]
        ranges = sorted({(low, high) for low, high in cut if low <= high})
    return ranges


def in_ranges(column: str, ranges: Ranges) -> Column:
    """A predicate on a partition column, by which folders are pruned."""
    found = F.lit(False)
    for low, high in ranges:
        found = found | F.col(column).between(low, high)
    return found


def read(spark: SparkSession, paths: Store) -> Ledger:
    """One small file and the names of the tail."""
    folder = storage.current(spark, paths.ledger)
    ranges = json.loads(storage.read_text(spark, f"{folder}/ranges.json")) if folder else []
    names = storage.children(spark, paths.commits) if storage.exists(spark, paths.commits) else []
    entries = [found.groups() for name in names if (found := _ENTRY.fullmatch(name))]
    tail, hidden = (sorted(int(number) for kind, number in entries if kind == wanted) for wanted in ("batch_id", "hidden"))
    return Ledger(folder, [tuple(x) for x in ranges], tail, hidden)


def rows(spark: SparkSession, paths: Store, ledger: Ledger | None = None) -> DataFrame:
    """One row per batch whose outputs are complete."""
    ledger = ledger or read(spark, paths)
    found = spark.createDataFrame([], BATCH_COMMIT)
    if ledger.folder:
        kept = spark.read.schema(BATCH_COMMIT).parquet(f"{ledger.folder}/rows")
        found = kept.filter(~F.col("batch_id").isin(ledger.replaced())) if ledger.replaced() else kept
    if ledger.tail:
        entries = [f"{paths.commits}/batch_id={number}" for number in ledger.tail]
        recent = spark.read.schema(BATCH_COMMIT).json(entries)
        found = found.unionByName(recent) if ledger.folder else recent
    return found


def hide(spark: SparkSession, paths: Store, batch_id: int) -> None:
    """Takes a batch out of the ledger until it is committed again."""
    if any(low <= batch_id <= high for low, high in read(spark, paths).ranges):
        storage.make_folder(spark, f"{paths.commits}/hidden={batch_id}")
    storage.delete(spark, f"{paths.commits}/batch_id={batch_id}")


def compact(spark: SparkSession, paths: Store) -> None:
    """Moves the tail into a new snapshot.

    The snapshot becomes current in one step. What is left of the tail if this stops half-way
    says the same as the snapshot, so it does no harm and goes the next time.
    """
    number = storage.version_number(spark, paths.ledger)
    ledger = read(spark, paths)
    folder = storage.new_version(paths.ledger)
    rows(spark, paths, ledger).coalesce(1).write.parquet(f"{folder}/rows")
    storage.write_text(spark, f"{folder}/ranges.json", json.dumps(ledger.visible()))
    storage.switch(spark, paths.ledger, folder, number)
    # What hides goes first: an entry that is still there then says the same as the snapshot.
    gone = [("hidden", x) for x in ledger.hidden] + [("batch_id", x) for x in ledger.tail]
    for kind, batch_id in gone:
        storage.delete(spark, f"{paths.commits}/{kind}={batch_id}")


def settle(spark: SparkSession, paths: Store) -> None:
    """Compacts a tail that has become long; for the writer of batches, between two of them."""
    ledger = read(spark, paths)
    if len(ledger.tail) + len(ledger.hidden) >= TAIL_BATCHES:
        compact(spark, paths)
