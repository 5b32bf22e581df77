"""Accounting over what landed: topics, pipeline outputs, cubes and confirmed lines."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from booklog.operators.envelope import verify_strictly
from booklog.schema import DIMENSIONS, ENVELOPE_STAGE, MEASURES, RECORD_STAGE

# Numbers of one bitmap.
BITMAP_BITS = 32768
# Lines whose runs are put in order together.
RUN_BLOCK = 1 << 20


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.any_value(name, True).alias(name) for name in stacked.columns])


def verify_topic(records: DataFrame) -> DataFrame:
    """Total, valid, invalid, and valid records beyond the first of their id.

    Copies are combined before the shuffle, which carries 32-byte ids.
    """
    verdicts = verify_strictly(records)
    per_id = verdicts.groupBy(F.unhex("verified_id").alias("id")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    copies, is_valid = F.col("copies"), F.col("id").isNotNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return per_id.agg(
        total(copies).alias("total"),
        total(F.when(is_valid, copies)).alias("valid"),
        total(F.when(~is_valid, copies)).alias("invalid"),
        total(F.when(is_valid, copies - 1)).alias("duplicate_event_ids"),
    )


def partition_counts(records: DataFrame) -> DataFrame:
    return (
        records.groupBy("partition").agg(F.count(F.lit(1)).alias("records")).orderBy("partition")
    )


def partition_offsets(records: DataFrame) -> DataFrame:
    """Records per partition with the first and last offset among them."""
    return records.groupBy("partition").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
    )


def topic_report(records: DataFrame, expected: int | None = None) -> DataFrame:
    """One row on a whole topic: totals, records per partition, and whether it is sound.

    Sound is a topic without invalid or repeated records and, if a number is expected, with
    that many. The partitions of a topic are few and make one map.
    """
    per_partition = partition_counts(records).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("partition", "records")))).alias("partition_counts")
    )
    counted = one_row(verify_topic(records), per_partition)
    sound = (F.col("invalid") == 0) & (F.col("duplicate_event_ids") == 0)
    if expected is not None:
        sound = sound & (F.col("total") == expected)
    return counted.withColumn("sound", sound)


def broker_locations(raw: DataFrame, dead: DataFrame) -> DataFrame:
    """Distinct broker positions of everything that was read.

    Records that failed as bookings are in both datasets, so only envelope failures are
    added to the raw events.
    """
    lost = dead.filter(F.col("failure_stage") == ENVELOPE_STAGE)
    return raw.select("partition", "offset").unionByName(lost.select("partition", "offset")).distinct()


def location_count(raw: DataFrame, dead: DataFrame) -> DataFrame:
    """How many distinct broker positions there are, shuffling one bit per position."""
    lost = dead.filter(F.col("failure_stage") == ENVELOPE_STAGE)
    positions = raw.select("partition", "offset").unionByName(lost.select("partition", "offset"))
    return _bitmaps(positions, ["partition"], F.col("offset") + 1).agg(
        F.coalesce(F.sum("present"), F.lit(0)).alias("unique_kafka_locations")
    )


def _words(df: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """Which of the numbers 1, 2, ... occur per key, as 64-bit words of 64 numbers.

    Words merge in place before the shuffle, so repeats cost nothing, and a key with a third
    of all rows spreads over as many groups as it has words.
    """
    place = (number - 1).cast("long")
    return df.groupBy(*keys, F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")
    )


def _bitmaps(df: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """The same as bitmaps of 32,768 numbers: how many occur, and how many before the first gap."""
    words = _words(df, keys, number)
    per_bitmap = BITMAP_BITS // 64
    own = F.struct((F.col("word") % per_bitmap).alias("at"), "bits")
    buckets = words.groupBy(*keys, (F.floor(F.col("word") / F.lit(per_bitmap)) + 1).alias("bucket")).agg(
        F.sum(F.bit_count("bits")).alias("present"), F.array_sort(F.collect_list(own)).alias("words")
    )
    # Words in order; the count goes on while each begins where it stands and was full before.
    leading = F.expr(
        """aggregate(words, 0L, (n, w) -> if(w.at * 64 = n,
            n + if(w.bits = -1L, 64, coalesce(bit_count(w.bits ^ try_add(w.bits, 1L)) - 1, 63)), n))"""
    )
    return buckets.withColumn("leading", leading.cast("long")).drop("words")


def pipeline_summary(
    raw: DataFrame, clean: DataFrame, dead: DataFrame, quality: DataFrame
) -> DataFrame:
    """Counts of the stored datasets and the two sums that must equal their input."""
    is_input = F.col("metric_name") == "input_count"
    counts = one_row(
        quality.agg(
            F.coalesce(F.sum(F.when(is_input, F.col("metric_value"))), F.lit(0)).alias("input_count")
        ),
        raw.agg(F.count(F.lit(1)).alias("envelope_valid_count")),
        clean.agg(F.count(F.lit(1)).alias("business_valid_count")),
        dead.agg(
            F.count(F.lit(1)).alias("dead_letter_count"),
            F.count_if(F.col("failure_stage") == ENVELOPE_STAGE).alias("envelope_dead"),
            F.count_if(F.col("failure_stage") == RECORD_STAGE).alias("record_dead"),
        ),
        location_count(raw, dead),
    )
    return counts.select(
        "input_count",
        "envelope_valid_count",
        "business_valid_count",
        "dead_letter_count",
        F.expr("envelope_valid_count + envelope_dead").alias("raw_plus_envelope_dead_count"),
        F.expr("business_valid_count + record_dead").alias("clean_plus_business_dead_count"),
        "unique_kafka_locations",
    )


def reconcile(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Cube keys whose measures differ or that only one side has."""
    sides = [
        df.select(*DIMENSIONS, *[F.col(name).alias(f"{side}_{name}") for name in MEASURES])
        for side, df in (("actual", actual), ("expected", expected))
    ]
    joined = sides[0].join(sides[1], DIMENSIONS, "full_outer")
    differs = [
        ~F.col(f"actual_{name}").eqNullSafe(F.col(f"expected_{name}")) for name in MEASURES
    ]
    return joined.filter(differs[0] | differs[1])


def confirmed_prefix(lines: DataFrame) -> DataFrame:
    """Per source, the last line such that it and every line before it landed.

    Input is ``source_file, source_line_number`` with any repeats. Lines become bitmaps,
    and the numbers of the full bitmaps become bitmaps again, so that the only window sees
    one row per 2**30 lines of a source.
    """
    source = "source_file"
    buckets = _bitmaps(lines, [source], F.col("source_line_number"))
    full = buckets.filter(F.col("present") == BITMAP_BITS)
    groups = _bitmaps(full, [source], F.col("bucket"))
    position, bucket = F.col("position"), F.col("bucket")
    stop = F.when(bucket > position, (position - 1) * BITMAP_BITS).when(
        F.col("leading") < BITMAP_BITS, (bucket - 1) * BITMAP_BITS + F.col("leading")
    )
    in_order = Window.partitionBy(source).orderBy("bucket")
    full_runs = (
        groups.withColumn("position", F.row_number().over(in_order).cast("long"))
        .groupBy(source)
        .agg(F.coalesce(F.min(stop), F.max(bucket) * BITMAP_BITS).alias("full_run"))
    )
    # One row per source: small enough at run time, the adaptive planner broadcasts it.
    placed = buckets.join(full_runs, source, "left").select(
        source, "bucket", "present", "leading", F.coalesce("full_run", F.lit(0)).alias("full_run")
    )
    partial = F.max(F.when(bucket == F.col("full_run") + 1, F.col("leading")))
    return placed.groupBy(source).agg(
        (F.max("full_run") * BITMAP_BITS + F.coalesce(partial, F.lit(0))).alias("confirmed_line"),
        F.sum("present").alias("distinct_lines"),
    )


def landed_runs(lines: DataFrame) -> DataFrame:
    """``source_file, first, last`` of the runs of landed lines inside each word of 64 lines."""
    words = _words(lines, ["source_file"], F.col("source_line_number"))
    first, last = "bits & ~shiftleft(bits, 1)", "bits & ~shiftrightunsigned(bits, 1)"
    places = "filter(sequence(0, 63), k -> (shiftrightunsigned({0}, k) & 1L) = 1L)"
    begins, ends = (F.expr(places.format(f"({of})")) for of in (first, last))
    runs = F.explode(F.arrays_zip(begins.alias("begins"), ends.alias("ends"))).alias("run")
    return words.select("source_file", "word", runs).select(
        "source_file",
        (F.col("word") * 64 + F.col("run.begins") + 1).alias("first"),
        (F.col("word") * 64 + F.col("run.ends") + 1).alias("last"),
    )


def joined_runs(runs: DataFrame, block_lines: int = RUN_BLOCK) -> DataFrame:
    """Runs of lines that touch or overlap, in any number and order, as one run each.

    A run opens a new one when it begins beyond the reach of all runs before it. That reach
    is a running maximum inside a block of lines, and over the blocks before, which have one
    row each; so no window spans all runs of a source, however many gaps it has.
    """
    source = "source_file"
    # One run per first line, so that the order inside a block is the same in both passes.
    longest = runs.groupBy(source, "first").agg(F.max("last").alias("last"))
    placed = longest.withColumn("block", F.floor((F.col("first") - 1) / F.lit(block_lines)))
    opening = _running(placed, F.col("last"), before_row=True)
    opens = F.col("running").isNull() | (F.col("first") > F.col("running") + 1)
    starts = opening.withColumn("start", F.when(opens, F.col("first"))).drop("running")
    return (
        _running(starts, F.col("start"), before_row=False)
        .groupBy(source, F.col("running").alias("first"))
        .agg(F.max("last").alias("last"))
    )


def _running(placed: DataFrame, value: Column, before_row: bool) -> DataFrame:
    """Runs with the greatest ``value`` of the runs before them, their own included or not."""
    source = "source_file"
    in_block = Window.partitionBy(source, "block").orderBy("first")
    rows = in_block.rowsBetween(Window.unboundedPreceding, -1 if before_row else 0)
    over_blocks = Window.partitionBy(source).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(source, "block").agg(F.max(value).alias("most"))
    earlier = blocks.select(source, "block", F.max("most").over(over_blocks).alias("earlier"))
    inside = placed.withColumn("inside", F.max(value).over(rows))
    both = inside.join(earlier, [source, "block"])
    return both.withColumn("running", F.greatest("inside", "earlier")).drop("inside", "earlier")


def prefix_of_runs(runs: DataFrame) -> DataFrame:
    """What ``confirmed_prefix`` returns, from joined runs."""
    return runs.groupBy("source_file").agg(
        F.coalesce(F.max(F.when(F.col("first") == 1, F.col("last"))), F.lit(0).cast("long")).alias(
            "confirmed_line"
        ),
        F.sum(F.expr("last - first + 1")).alias("distinct_lines"),
    )


def line_gaps(lines: DataFrame) -> DataFrame:
    """Runs of lines that did not land before a later line that did, per source.

    Lines become 64-bit words, and words the runs of landed lines inside them, so what is
    sorted is a fraction of the lines.
    """
    spans = _with_previous(landed_runs(lines), BITMAP_BITS, levels=2)
    return spans.filter("first - previous > 1").select(
        "source_file",
        F.expr("previous + 1").alias("first_missing"),
        F.expr("first - 1").alias("last_missing"),
    )


def _with_previous(spans: DataFrame, width: int, levels: int) -> DataFrame:
    """Each span with the end of the span before it in its source, 0 for the first.

    Spans look back inside blocks of ``width`` lines; the first span of a block looks back
    through the blocks, one level up. No window ever spans all lines of a source.
    """
    source = "source_file"
    blocks = spans.withColumn("block", F.floor((F.col("first") - 1) / F.lit(width)))
    in_block = Window.partitionBy(source, "block").orderBy("first")
    inner = blocks.withColumn("previous", F.lag("last").over(in_block)).filter(
        "previous IS NOT NULL"
    )
    edges = blocks.groupBy(source, "block").agg(
        F.min("first").alias("first"), F.max("last").alias("last")
    )
    if levels > 1:
        outer = _with_previous(edges.drop("block"), width * BITMAP_BITS, levels - 1)
    else:
        in_source = Window.partitionBy(source).orderBy("first")
        outer = edges.withColumn(
            "previous", F.coalesce(F.lag("last").over(in_source), F.lit(0).cast("long"))
        )
    columns = [source, "first", "last", "previous"]
    return inner.select(*columns).unionByName(outer.select(*columns))
