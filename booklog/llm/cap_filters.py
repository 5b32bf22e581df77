"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a direction put together from one codeword per half of the (rotated) space, so that
few codewords make many filters. Every vector lists all filters that it exceeds by decoding the
product code; vectors with equal labels meet in common filters and are verified there.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import batch_of, stored

COSINE = 0.93
# Codewords per half, and the least score of a filter in standard deviations of a random one.
CODEWORDS = 128
CAP = 2.75
LEAST_DIMENSIONS = 64
# Rows of a filter that one task compares with each other; fuller filters are split.
BUCKET_ROWS = 4096
_BLOCK = 1024
_PAIR_WORDS = 1 << 20


@lru_cache(maxsize=4)
def code(dimensions: int, codewords: int) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation and two codebooks of unit vectors, the same in every task."""
    random = np.random.default_rng(dimensions)
    rotation, _ = np.linalg.qr(random.standard_normal((dimensions, dimensions)))
    books = random.standard_normal((2, codewords, dimensions // 2))
    return rotation, books / np.linalg.norm(books, axis=2, keepdims=True) / np.sqrt(2)


def filters(units: np.ndarray, codewords: int = CODEWORDS, cap: float = CAP) -> list[np.ndarray]:
    """All filters that each unit vector exceeds, in order.

    A codeword of the first half is tried only where the best one of the second half could
    still lift it over the threshold.
    """
    size = max(LEAST_DIMENSIONS, units.shape[1] + units.shape[1] % 2)
    rotation, books = code(size, codewords)
    turned = units @ rotation[: units.shape[1]]
    first, second = turned[:, : size // 2] @ books[0].T, turned[:, size // 2 :] @ books[1].T
    threshold = cap / np.sqrt(size)
    owner, left = np.nonzero(first >= threshold - second.max(axis=1)[:, None])
    row, right = np.nonzero(second[owner] >= (threshold - first[owner, left])[:, None])
    found = left[row] * codewords + right
    return np.split(found, np.searchsorted(owner[row], np.arange(1, len(units))))


def _usable(labels: pa.Array, vectors: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows that can link, with their vectors as a matrix, by number of components.

    Left out are rows whose label or vector is null, and vectors that are empty, zero or hold a
    null or non-finite component. Nothing is done component by component outside of numpy.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    # Null components become NaN; null lists have none.
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    owners, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    broken = np.bincount(owners[~np.isfinite(values)], minlength=len(sizes))
    filled = np.bincount(owners[values != 0], minlength=len(sizes))
    named = pc.is_valid(labels).to_numpy(zero_copy_only=False)
    usable = named & (broken == 0) & (filled > 0)
    found = []
    for size in np.unique(sizes[usable]):
        mine = np.flatnonzero(usable & (sizes == size))
        found.append((mine, values[starts[mine, None] + np.arange(size)]))
    return found


def decoded(vectors: DataFrame, codewords: int, cap: float) -> DataFrame:
    """Every row with its class (equal label and components), and its filters; stored.

    The class is null where the row links with nothing.
    """
    schema = pa.schema(
        [
            ("vec_id", pa.int64()), ("label", pa.string()), ("class", pa.binary()), ("dimensions", pa.int32()),
            ("vector", pa.binary()), ("filters", pa.binary()),
        ]
    )

    def decode(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, _BLOCK):
                rows = whole.slice(low, _BLOCK)
                labels = rows.column("label").to_pylist()
                classes, sizes, short, found = ([None] * rows.num_rows for _ in range(4))
                for mine, matrix in _usable(rows.column("label"), rows.column("embedding")):
                    listed = filters(_units(matrix), codewords, cap)
                    for at, values, one in zip(mine.tolist(), matrix, listed, strict=True):
                        packed = str(labels[at]).encode() + b"\0" + (values + 0.0).tobytes()
                        classes[at], sizes[at] = xxhash.xxh3_128_digest(packed), len(values)
                        short[at], found[at] = _shortened(values), one.astype("<u4").tobytes()
                yield batch_of(schema, rows.column("vec_id"), labels, classes, sizes, short, found)

    read = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")
    )
    columns = "vec_id long, label string, class binary, dimensions int, vector binary, filters binary"
    return stored(read.mapInArrow(decode, columns), "vectors")


def _shortened(values: np.ndarray) -> bytes:
    """In single precision where that is exact, to halve what is shuffled."""
    with np.errstate(over="ignore"):
        single = values.astype(np.float32)
    return single.tobytes() if (single == values).all() else values.tobytes()


def _lengthened(rows: pa.Table, dimensions: int) -> np.ndarray:
    kinds = {4 * dimensions: np.float32, 8 * dimensions: np.float64}
    packed = rows.column("vector").to_pylist()
    return np.array([np.frombuffer(x, kinds[len(x)]) for x in packed], np.float64)


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _spread(classes: DataFrame) -> DataFrame:
    """A row per class and filter."""

    def spread(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                rows = whole.slice(low, 256)
                found = [np.frombuffer(x, "<u4") for x in rows.column("filters").to_pylist()]
                owners = np.repeat(np.arange(len(found)), [len(x) for x in found])
                every = np.concatenate(found).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(owners)) for c in rows.columns), pa.array(every)], names=[*rows.schema.names, "filter"]
                )

    return classes.mapInArrow(spread, T.StructType([*classes.schema.fields, T.StructField("filter", T.IntegerType())]))


def dealt(classes: DataFrame) -> DataFrame:
    """A row per class and filter, with the pair of parts in which a full filter compares it.

    A filter with more than ``BUCKET_ROWS`` rows is cut into parts by hash; each part meets
    itself and every other part in a group of its own, so no group grows with the filter.
    """
    rows = _spread(classes)
    key = ["label", "dimensions", "filter"]
    full = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_ROWS)
    parts = full.select(*key, F.ceil(2 * F.col("n") / F.lit(BUCKET_ROWS)).cast("int").alias("parts"))
    rows = rows.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return rows.withColumns({"low": low, "high": high}).drop("other")


def _merge(roots: np.ndarray, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
    """Puts linked rows below one root."""
    for at in np.flatnonzero(linked.any(axis=1)).tolist():
        met = np.unique(np.append(roots[columns[linked[at]]], roots[rows[at]]))
        if len(met) > 1:
            roots[np.isin(roots, met)] = met[0]


def _first_links(linked: np.ndarray, left: np.ndarray, right: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The copies that each row is linked with and shares no earlier filter with."""
    rows, columns = np.nonzero(linked)
    found = np.zeros(len(linked), np.int64)
    step = max(1, _PAIR_WORDS // left.shape[1])
    for low in range(0, len(rows), step):
        a, b = rows[low : low + step], columns[low : low + step]
        fresh = ~(left[a] & right[b]).any(axis=1)
        found += np.bincount(a[fresh], copies[b[fresh]], len(linked)).astype(np.int64)
    return found


def _compared(rows: pa.Table, cosine: float):
    """Links of each row counted in this filter only, and a forest that connects the linked."""
    number = rows.column("filter")[0].as_py()
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    parts = rows.column("part").to_numpy()
    vectors = _lengthened(rows, rows.column("dimensions")[0].as_py())
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    lengths = np.linalg.norm(scaled, axis=1)
    copies = rows.column("copies").to_numpy()
    lists = [np.frombuffer(x, "<u4") for x in rows.column("filters").to_pylist()]
    every = np.concatenate(lists).astype(np.int64)
    owners = np.repeat(np.arange(rows.num_rows), [len(x) for x in lists])
    # Filters before this one: a pair that shares one of them is counted there.
    before = every < number
    _, columns, counts = np.unique(every[before], return_inverse=True, return_counts=True)
    column_of = np.cumsum(counts > 1) - 1
    shared = (counts > 1)[columns]
    places = column_of[columns[shared]]
    # A bit per earlier filter that two rows or more have: at most 2 KiB a row.
    member = np.zeros((rows.num_rows, int((counts > 1).sum()) // 64 + 1), np.uint64)
    bits = np.uint64(1) << (places % 64).astype(np.uint64)
    np.bitwise_or.at(member, (owners[before][shared], places // 64), bits)
    links = np.zeros(rows.num_rows, np.int64)
    roots = np.arange(rows.num_rows)
    numbers = np.arange(rows.num_rows)
    for top in range(0, rows.num_rows, _BLOCK):
        for left in range(0, rows.num_rows, _BLOCK):
            i, j = slice(top, top + _BLOCK), slice(left, left + _BLOCK)
            linked = scaled[i] @ scaled[j].T >= cosine * lengths[i, None] * lengths[None, j]
            linked &= numbers[i, None] != numbers[None, j]
            if low != high:
                linked &= parts[i, None] != parts[None, j]
            if not linked.any():
                continue
            _merge(roots, numbers[i], numbers[j], linked)
            links[i] += _first_links(linked, member[i], member[j], copies[j])
    return links, roots


def verified(buckets: DataFrame, cosine: float) -> DataFrame:
    """``class, n_links, root``: links counted per filter, and a class it is connected to; stored."""
    schema = pa.schema([("class", pa.binary()), ("n_links", pa.int64()), ("root", pa.binary())])
    key = ["label", "dimensions", "filter", "low", "high"]
    columns = [*key, "part", "class", "vector", "filters", "copies"]

    def compare(batches):
        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            edges = [at for at in range(len(keys)) if at == 0 or keys[at] != keys[at - 1]]
            for low, high in zip(edges, [*edges[1:], len(keys)], strict=True):
                if keys[low] != last and held:
                    if (found := judge(held)) is not None:
                        yield found
                    held = []
                last = keys[low]
                held.append(batch.slice(low, high - low))
        if held and (found := judge(held)) is not None:
            yield found

    def judge(held):
        rows = pa.Table.from_batches(held)
        if rows.num_rows < 2:
            return None
        links, roots = _compared(rows, cosine)
        told = np.flatnonzero((links > 0) | (roots != np.arange(len(roots))))
        names = rows.column("class").combine_chunks()
        return batch_of(schema, names.take(pa.array(told)), links[told], names.take(pa.array(roots[told]))) if len(told) else None

    sorted_rows = buckets.select(*columns).repartition(*key).sortWithinPartitions(*key)
    return stored(sorted_rows.mapInArrow(compare, "class binary, n_links long, root binary"), "vector-links")


def near_duplicate_vectors(
    vectors: DataFrame, cosine: float = COSINE, codewords: int = CODEWORDS, cap: float = CAP
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Rows with equal, not null labels and as many components are linked where their cosine, in
    double precision, reaches ``cosine``. Rows with equal components are linked with each other
    and compared with the rest once. Null, empty or zero vectors and those with a null or
    non-finite component link with nothing. Rows without an id take part; a component's id is
    its smallest. Rows with equal ids are rows of their own. Links are found where two vectors
    share a filter, and none below ``cosine`` is reported. Only ``vec_id``, ``label`` and
    ``embedding`` are read, so further columns, whatever their names, do not matter.
    """
    rows = decoded(vectors, codewords, cap)
    counts = rows.filter("class IS NOT NULL").groupBy("class").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    )
    counts = stored(counts, "vector-classes")
    one_each = rows.filter("class IS NOT NULL").dropDuplicates(["class"]).drop("vec_id")
    found = verified(dealt(one_each.join(counts.select("class", "copies"), "class")), cosine)
    links = found.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    rooted = counts.join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "copies", "least", F.coalesce("root", "class").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(groups, "root").join(links, "class", "left").select(
        "class", "component_id", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")
    )
    joined = rows.select("vec_id", "class").join(of_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
