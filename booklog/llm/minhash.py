"""Near-duplicate documents: b-bit MinHash proposes, whole shingle sets decide.

Documents with equal shingle sets form a class; classes are compared, not documents. Band keys
of the minima propose pairs of classes, packed low bits of the minima weed them out, and the
rest is confirmed on whole sets. Within a bucket not all pairs are proposed: first each
class's closest one and the one that is close to most; then, once these are confirmed, only
close pairs that are not yet connected. A crowded bucket proposes pairs with its hubs first, and
is cut into parts that meet in groups of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import NOT_BLANK, mix, shingle_hashes, word_hashes, word_spans
from .shared import batch_of, filter_of, in_filter, stored, text_key, text_slices, unused, where_in, whole_text

WORDS = 5
SIMILARITY = 80  # hundredths
HASHES = 64
BITS = 4
ROWS = 3
BANDS = HASHES // ROWS
# Of the finer sketch that only documents with a close one get.
SKETCH_HASHES = 1024
SKETCH_BITS = 2
# Standard errors below the threshold at which an estimate still counts as close.
MARGIN = 4.0
# Classes of a bucket that one task compares with each other; fuller buckets are split.
BUCKET_ROWS = 4096
# Classes of a fuller bucket that all others are compared with first.
HUBS = 64
_BLOCK = 256

_random = np.random.default_rng(77)
_ADD = _random.integers(0, 2**32, SKETCH_HASHES, dtype=np.uint32)
_MULTIPLY = _random.integers(0, 2**31, SKETCH_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(similarity: int = SIMILARITY, hashes: int = HASHES, bits: int = BITS) -> int:
    """Equal low-bit patterns of two signatures from which a pair counts as close.

    Patterns of different minima are equal once in 2^bits, so at similarity s a share of
    s + (1 - s) / 2^bits agrees; the bound lies ``MARGIN`` standard errors below.
    """
    chance = 1 / (1 << bits)
    share = similarity / 100 * (1 - chance) + chance
    return max(1, math.floor(hashes * (share - MARGIN * math.sqrt(share * (1 - share) / hashes))))


def estimate(matches: int, hashes: int = HASHES, bits: int = BITS) -> float:
    """The similarity that so many equal patterns speak for, corrected for chance."""
    chance = 1 / (1 << bits)
    return max(0.0, (matches / hashes - chance) / (1 - chance))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; of all words where there are fewer."""
    starts, ends = word_spans(data, bounds, NOT_BLANK)
    hashes = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, bounds)
    return [
        np.unique(shingle_hashes(hashes[a:b], words))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
    ]


def minima(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """The least value of each hash function on each of the sets, none of which is empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    begins = np.cumsum(sizes) - sizes
    values = np.concatenate(sets)
    values = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    found = np.empty((len(sets), hashes), np.uint32)
    for at in range(hashes):
        hashed = (values ^ _ADD[at]) * _MULTIPLY[at]
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        found[:, at] = np.minimum.reduceat(hashed, begins)
    return found


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(least), 1))
    for row in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, row : BANDS * ROWS : ROWS].astype(np.uint64))
    return keys.view(np.int64)


def signatures(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    low = mix(least.astype(np.uint64)) & np.uint64((1 << bits) - 1)
    per_word = 64 // bits
    shifts = np.arange(per_word, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_or.reduce(low.reshape(len(least), -1, per_word) << shifts, axis=2)


def equal_patterns(left: np.ndarray, right: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Equal patterns between all rows of two signature tables, by bit counts."""
    different = left[:, None, :] ^ right[None, :, :]
    step = 1
    while step < bits:
        different |= different >> np.uint64(step)
        step *= 2
    ones = np.uint64(sum(1 << (bits * k) for k in range(64 // bits)))
    return left.shape[1] * 64 // bits - np.bitwise_count(different & ones).sum(axis=2, dtype=np.int64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """A row per row of ``docs``, stored: its class, and the bands and signature of its set."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("key_1", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()),
            ("bands", pa.list_(pa.int64())), ("signature", pa.binary()),
        ]
    )

    def sign(batches):
        for rows, data, bounds in text_slices(batches, "text"):
            sets = shingle_sets(data, bounds, words)
            full = [x for x in sets if len(x)]
            least = minima(full) if full else np.zeros((0, HASHES), np.uint32)
            found = iter(zip(band_keys(least), signatures(least), strict=True))
            bands, packed = [], []
            for one in sets:
                keys, bits = next(found) if len(one) else (None, None)
                bands.append(keys)
                packed.append(None if bits is None else bits.tobytes())
            classes = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield batch_of(schema, rows.column("doc_id"), rows.column("key_1"), [len(x) for x in sets], classes, bands, packed)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    read = read.select("doc_id", text_key(F.col("text"))[0], "text")
    columns = "doc_id long, key_1 long, n_shingles long, class binary, bands array<long>, signature binary"
    return stored(read.mapInArrow(sign, columns), "minhash-rows")


def buckets(classes: DataFrame) -> DataFrame:
    """``band, class, signature`` of classes that share a band with another class.

    Bands that occur once are dropped by a bitmap of fixed size before anything is shuffled.
    """
    counts = classes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    shared = classes.sparkSession.sparkContext.broadcast(filter_of(counts.filter("n > 1"), "band"))
    schema = pa.schema([("band", pa.int64()), ("class", pa.binary()), ("signature", pa.binary())])

    def spread(batches):
        for batch in batches:
            bands = batch.column("bands").flatten().to_numpy()
            kept = np.flatnonzero(in_filter(shared.value, bands))
            owners = pa.array(kept // BANDS)
            yield batch_of(schema, bands[kept], batch.column("class").take(owners), batch.column("signature").take(owners))

    columns = "band long, class binary, signature binary"
    return classes.select("bands", "class", "signature").mapInArrow(spread, columns)


def _parts(rows: Column) -> Column:
    """Parts of about half of ``BUCKET_ROWS``, so that two of them make one group."""
    return F.ceil(2 * rows / F.lit(BUCKET_ROWS)).cast("int")


def _part_of(parts: Column) -> Column:
    return F.pmod(F.xxhash64("class"), parts).cast("int")


def crowded(bucketed: DataFrame) -> DataFrame:
    """``band, parts`` of the buckets with more than ``BUCKET_ROWS`` classes, stored."""
    counts = bucketed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_ROWS)
    return stored(counts.select("band", _parts(F.col("n")).alias("parts")), "minhash-crowded")


def dealt(labelled: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of buckets, with the pair of parts in which a crowded bucket compares them.

    The most frequent root of a crowded bucket has parts of its own, which meet all other parts
    but not each other, as their rows are connected. A bucket with one root is left out.
    """
    counts = labelled.select("band", "root").join(full.select("band"), "band")
    counts = counts.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "root"))
    mains = counts.groupBy("band").agg(largest.alias("main"), F.sum("n").alias("n"))
    mains = mains.select(
        "band", F.col("main.root").alias("main"), _parts(F.col("main.n")).alias("of_main"),
        _parts(F.col("n") - F.col("main.n")).alias("of_rest"),
    )
    rows = labelled.join(stored(mains, "minhash-mains"), "band", "left")
    one = rows.filter("main IS NULL").withColumns({"part": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    many = rows.filter("of_rest > 0")
    connected, rest, main = F.col("root") == F.col("main"), F.col("of_rest"), F.col("of_main")
    many = many.withColumn("part", F.when(connected, rest + _part_of(main)).otherwise(_part_of(rest)))
    last = F.when(connected, rest - 1).otherwise(rest + main - 1)
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    many = many.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    columns = [*labelled.columns, "part", "low", "high"]
    return one.select(*columns).unionByName(many.select(*columns))


def _by_bucket(batches, keys: list[str], columns: list[str]):
    """The rows of each bucket or part of one, of batches sorted by ``keys``."""
    last, held = None, []
    for batch in batches:
        found = np.stack([batch.column(key).to_numpy().astype(np.int64) for key in keys], axis=1)
        changes = (found[1:] != found[:-1]).any(axis=1)
        edges = np.flatnonzero(np.append(True, changes)).tolist() if len(found) else []
        for low, high in zip(edges, [*edges[1:], len(found)], strict=True):
            key = found[low].tolist()
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low).select(columns))
    if held:
        yield pa.Table.from_batches(held)


def _packed(rows: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), np.uint64).reshape(rows.num_rows, -1)


def _blocks(table: np.ndarray):
    for low in range(0, len(table), _BLOCK):
        for right in range(low, len(table), _BLOCK):
            yield low, right, equal_patterns(table[low : low + _BLOCK], table[right : right + _BLOCK])


def nearest_and_central(table: np.ndarray, enough: int) -> set[tuple[int, int]]:
    """For each row its closest other row, and the row that is close to most, if close."""
    size = len(table)
    best, other, degree = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for left, right, matches in _blocks(table):
        if left == right:
            np.fill_diagonal(matches, -1)
        for begin, found in ((left, matches), (right, matches.T)):
            rows = slice(begin, begin + len(found))
            top = found.argmax(axis=1)
            value = found[np.arange(len(found)), top]
            better = value > best[rows]
            offset = right if begin == left and found is matches else left
            other[rows] = np.where(better, top + offset, other[rows])
            best[rows] = np.maximum(best[rows], value)
            degree[rows] += (found >= enough).sum(axis=1)
            if left == right:
                break
    pairs = {(min(a, b), max(a, b)) for a, b in enumerate(other.tolist()) if best[a] >= enough}
    centre = int(degree.argmax())
    close = np.flatnonzero(equal_patterns(table, table[centre : centre + 1])[:, 0] >= enough)
    return pairs | {(min(a, centre), max(a, centre)) for a in close.tolist() if a != centre}


def proposed(bucketed: DataFrame, enough: int) -> DataFrame:
    """First proposals, as distinct ``a, b`` with ``a < b``."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def propose(batches):
        left, right = [], []
        for rows in _by_bucket(batches, ["band"], ["class", "signature"]):
            if rows.num_rows < 2:
                continue
            names = rows.column("class").to_pylist()
            for a, b in nearest_and_central(_packed(rows, "signature"), enough):
                left.append(min(names[a], names[b]))
                right.append(max(names[a], names[b]))
            if len(left) > 50_000:
                yield batch_of(schema, left, right)
                left, right = [], []
        yield batch_of(schema, left, right)

    dealt = bucketed.repartition("band").sortWithinPartitions("band", "class")
    return dealt.mapInArrow(propose, "a binary, b binary").filter("a != b").distinct()


def near_hubs(bucketed: DataFrame, enough: int) -> DataFrame:
    """First proposals in crowded buckets, whose rows have ``parts``; as distinct ``a, b``.

    A bucket has a hub per hash of its classes, at most ``HUBS``; each class is proposed with
    the closest and the first of those it is close to.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def propose(batches):
        for rows in _by_bucket(batches, ["band", "part"], ["is_hub", "class", "signature"]):
            is_hub = rows.column("is_hub").to_numpy()
            own, hubs = np.flatnonzero(~is_hub), np.flatnonzero(is_hub)
            table, classes = _packed(rows, "signature"), _packed(rows, "class")
            names = rows.column("class").combine_chunks()
            for low in range(0, len(own), _BLOCK):
                some = own[low : low + _BLOCK]
                matches = equal_patterns(table[some], table[hubs])
                matches[(classes[some, None] == classes[None, hubs]).all(axis=2)] = -1
                close = matches >= enough
                mine = close.any(axis=1)
                for chosen in (matches.argmax(axis=1), close.argmax(axis=1)):
                    yield batch_of(schema, names.take(pa.array(some[mine])), names.take(pa.array(hubs[chosen[mine]])))

    salt = F.pmod(F.xxhash64("class"), F.lit(HUBS)).alias("salt")
    hubs = bucketed.groupBy("band", "parts", salt).agg(F.min(F.struct("class", "signature")).alias("hub"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    hubs = hubs.select("band", everywhere, F.lit(True).alias("is_hub"), "hub.class", "hub.signature")
    own = bucketed.select("band", _part_of(F.col("parts")).alias("part"), F.lit(False).alias("is_hub"), "class", "signature")
    together = own.unionByName(hubs).repartition("band", "part").sortWithinPartitions("band", "part", "class")
    found = together.mapInArrow(propose, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def unconnected(bucketed: DataFrame, full: DataFrame, sketched: DataFrame, similarity: int) -> DataFrame:
    """Close pairs of a bucket that confirmed links do not connect yet.

    They are weeded out by the finer sketch, since a large group of copies may have many that
    are almost similar enough. A pair is proposed in the first band that it shares only.
    """
    enough = least_matches(similarity, SKETCH_HASHES, SKETCH_BITS)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    key = ["band", "low", "high"]

    def propose(batches):
        for rows in _by_bucket(batches, key, [*key, "part", "class", "bands", "sketch", "root"]):
            codes = rows.column("root").combine_chunks().dictionary_encode()
            codes = codes.indices.to_numpy()
            if len(codes) < 2 or (codes == codes[0]).all():
                continue
            parts = rows.column("part").to_numpy()
            across = rows.column("low")[0] != rows.column("high")[0]
            # Blocks of one part or root are passed over.
            order = np.lexsort((codes, parts))
            codes, parts = codes[order], parts[order]
            names = rows.column("class").combine_chunks().take(pa.array(order))
            bands, own = _packed(rows, "bands")[order], np.uint64(rows.column("band")[0].as_py() % (1 << 64))
            sketches = _packed(rows, "sketch")[order]
            for left in range(0, len(order), _BLOCK):
                for right in range(left, len(order), _BLOCK):
                    i, j = slice(left, left + _BLOCK), slice(right, right + _BLOCK)
                    apart = codes[i, None] != codes[None, j]
                    if across:
                        apart &= parts[i, None] != parts[None, j]
                    if not apart.any():
                        continue
                    matches = equal_patterns(sketches[i], sketches[j], SKETCH_BITS)
                    a, b = np.nonzero((matches >= enough) & apart)
                    shared = bands[a + left] == bands[b + right]
                    first = bands[a + left, shared.argmax(axis=1)] == own
                    a, b = a[first], b[first]
                    if len(a):
                        yield batch_of(schema, names.take(pa.array(a + left)), names.take(pa.array(b + right)))

    labelled = bucketed.select("band", "class").join(sketched, "class")
    labelled = labelled.select("band", "class", "bands", "sketch", "root")
    grouped = dealt(labelled, full).repartition(*key).sortWithinPartitions(*key, "class")
    found = grouped.mapInArrow(propose, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_of(docs: DataFrame, wanted: np.ndarray, words: int) -> DataFrame:
    """``class, members, bands, sketch`` of texts whose key is in the bitmap, once per class, stored."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    binaries = [(name, pa.binary()) for name in ("bands", "sketch")]
    schema = pa.schema([("class", pa.binary()), ("members", pa.list_(pa.int64())), *binaries])

    def gather(batches):
        for batch in batches:
            kept = batch.filter(pa.array(in_filter(shared.value, batch.column("key_1").to_numpy())))
            for _, data, bounds in text_slices([kept], "text"):
                sets = [x for x in shingle_sets(data, bounds, words) if len(x)]
                if not sets:
                    continue
                classes = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                least = minima(sets, SKETCH_HASHES)
                packed = [[x.tobytes() for x in y] for y in (band_keys(least), signatures(least, SKETCH_BITS))]
                yield batch_of(schema, classes, [x.view(np.int64) for x in sets], *packed)

    read = docs.select(text_key(whole_text())[0], whole_text().alias("text"))
    found = read.mapInArrow(gather, "class binary, members array<long>, bands binary, sketch binary")
    return stored(found.dropDuplicates(["class"]), "minhash-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose whole sets are similar enough, stored."""
    left = sets.select(F.col("class").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("members").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    joined = pairs.join(left, "a").join(right, "b")
    similar = 100 * common >= similarity * (F.size("left") + F.size("right") - common)
    return stored(joined.filter(similar).select("a", "b"), "minhash-links")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Rows are linked where the Jaccard similarity of their distinct word shingles reaches
    ``similarity`` hundredths; words are split at white space, with A-Z in lower case. A text
    with fewer words than a shingle has one; an empty or null text has none and is linked with
    nothing. ``component_id`` is the smallest id reachable; rows without an id take part, and
    their component has one if any row in it does. Rows with equal ids are rows of their own,
    and each with the component's id is kept. Other columns are not read.

    A pair at the threshold is missed by all bands with probability (1 - 0.8^ROWS)^BANDS,
    about 3e-7, and by the estimate with about 3e-5.
    """
    rows = signed(docs, words)
    classes = rows.filter("n_shingles > 0").dropDuplicates(["class"])
    classes = stored(classes.select("class", "key_1", "bands", "signature"), "minhash-classes")
    bucketed = stored(buckets(classes), "minhash-buckets")
    enough = least_matches(similarity)
    full = crowded(bucketed)
    many = stored(bucketed.join(full, "band"), "minhash-many")
    first = proposed(bucketed.join(full, "band", "left_anti"), enough).unionByName(near_hubs(many, enough))
    pairs = stored(first.distinct(), "minhash-pairs")
    nodes = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))
    nodes = nodes.unionByName(many.select("class")).distinct()
    wanted = classes.join(nodes, "class").select("key_1")
    sets = sets_of(docs, filter_of(wanted, "key_1"), words)
    links = confirmed(pairs, sets, similarity)
    roots = components(links)
    sketched = sets.drop("members").join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "bands", "sketch", F.coalesce("root", "class").alias("root")
    )
    more = stored(unconnected(bucketed, full, sketched, similarity), "minhash-more")
    links = links.unionByName(confirmed(more.join(pairs, ["a", "b"], "left_anti"), sets, similarity))
    roots = components(links)
    least = rows.groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, F.col("class") == F.col("node"), "left").select(
        "class", F.coalesce("root", "class").alias("root"), "least"
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(groups, "root").select("class", "component_id")
    joined = rows.select("doc_id", "n_shingles", "class").join(of_class, "class")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of copies.

    ``docs`` must be a stored table, whose rows keep their numbers when it is read again. The
    row with the smallest id stays, of equal ids that with the smallest number; one without an
    id stays only where the group has none.
    """
    number = unused(docs, "number of the row")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    rows = numbered.select(F.col(number).alias("doc_id"), whole_text().alias("text"))
    found = stored(near_duplicates(rows, words, similarity), "minhash-groups")
    grouped = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = found.join(grouped, "component_id").select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select(F.col(number).alias("row"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    members = stored(ids.join(shared, "row").select("row", "component_id", order.alias("rank")), "minhash-members")
    first = members.groupBy("component_id").agg(F.min("rank").alias("first"))
    gone = members.join(first, "component_id").filter(F.col("row") != F.col("first.row"))
    gone = stored(gone.select(F.col("row").alias(number), F.xxhash64("row").alias("slot")), "minhash-gone")
    # Only rows that the bitmap can't rule out are shuffled to be looked up.
    bitmap = filter_of(gone, "slot")
    known = where_in(bitmap, docs.sparkSession, F.xxhash64(number))
    clear, doubtful = numbered.filter(~known), numbered.filter(known)
    kept = doubtful.join(gone.select(number), number, "left_anti")
    return clear.unionByName(kept).select(*docs.columns)

