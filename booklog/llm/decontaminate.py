"""Benchmark decontamination with suffix arrays of the training texts.

Each task builds suffix arrays over the words of a few megabytes of documents, one shard after
the other, and looks up every suffix of the test items by binary search. No text is shuffled.
Test items are sent to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import ALPHANUMERIC, mix, powers, prefix_sums, word_hashes, word_spans
from .shared import text_slices, where_text, whole_text

WINDOW = 10
SHARD_BYTES = 4 << 20
# Text of the test items that is sent to the tasks at once.
BLOCK_BYTES = 16 << 20
REPORT = (
    "row long, doc_id long, n_words long, hits array<struct<start:long,end:long>>, item_ids array<string>, "
    "matches array<struct<item_id:string,offset:long,length:long,start:long>>"
)


@dataclass(frozen=True)
class Items:
    """The words of test items one after the other, and their suffixes to look up."""

    ids: list[str | None]
    words: np.ndarray
    sums: np.ndarray
    ends: np.ndarray  # of each word's item
    owners: np.ndarray  # the item of each word
    offsets: np.ndarray  # of each word in its item
    windows: np.ndarray  # words that a window starting here has; 0 where none starts

    @property
    def depth(self) -> int:
        return int((self.ends - np.arange(len(self.words))).max(initial=1))


def hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, never 0, and the first word of each text (with an end)."""
    starts, ends = word_spans(data, bounds, ALPHANUMERIC)
    words = word_hashes(data, starts, ends)
    words[words == 0] = 1
    return words, np.searchsorted(starts, bounds)


def items_of(rows: list[tuple[str | None, str]], window: int = WINDOW) -> Items:
    texts = [text.encode() for _, text in rows]
    bounds = np.cumsum([0, *map(len, texts)])
    words, first = hashed_words(np.frombuffer(b"".join(texts), np.uint8), bounds)
    sizes = np.diff(first)
    owners = np.repeat(np.arange(len(rows)), sizes)
    offsets = np.arange(len(words)) - first[owners]
    ends = first[owners + 1] if len(words) else np.zeros(0, np.int64)
    length = np.minimum(sizes[owners], window)
    windows = np.where(offsets + length <= sizes[owners], length, 0)
    return Items([x for x, _ in rows], words, prefix_sums(words), ends, owners, offsets, windows)


def item_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """The distinct test items in blocks of about half of ``block_bytes``, by their hash."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), whole_text().alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-2 * total // block_bytes)
    for block in range(count):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield items_of([(r.item_id, r.text) for r in mine.collect()], window)


def suffix_array(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` words at least, by doubling.

    ``left`` counts the words from each place to the end of its text; comparisons stop there.
    Only suffixes that still tie with a neighbour are sorted again.
    """
    size = len(words)
    order = np.argsort(words, kind="stable")
    fresh = np.ones(size, bool)
    fresh[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.empty(size + 1, np.int64)
    rank[size] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(size), 0))
    known = 1
    tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
    while known < depth:
        tied = tied[left[order[tied]] >= known]
        if not len(tied):
            break
        suffixes = order[tied]
        keys = rank[suffixes] * (size + 2) + rank[np.minimum(suffixes + known, size)] + 1
        by_key = np.argsort(keys, kind="stable")
        suffixes, keys = suffixes[by_key], keys[by_key]
        order[tied] = suffixes
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        rank[suffixes] = tied[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        tied = tied[~first | ~np.append(first[1:], True)]
        known *= 2
    return order


@dataclass(frozen=True)
class Shard:
    """A suffix array over texts; each text's words are followed by a 0 that no word equals."""

    words: np.ndarray
    first: np.ndarray  # of each text, with an end
    order: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, first: np.ndarray, depth: int) -> Shard:
        sizes = np.diff(first)
        places = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
        spread = np.zeros(len(words) + len(sizes), np.uint64)
        spread[places] = words
        begins = first + np.arange(len(first))
        left = np.repeat(begins[1:] - 1, sizes + 1) - np.arange(len(spread))
        return cls(spread, begins, suffix_array(spread, left, depth))

    def narrowed(self, low, high, at: int, sought: np.ndarray):
        """The part of each range of suffixes whose word ``at`` is the sought one."""
        found = []
        for after in (False, True):
            a, b = low.copy(), high.copy()
            while True:
                active = np.flatnonzero(a < b)
                if not len(active):
                    break
                middle = (a[active] + b[active]) // 2
                word = self.words[self.order[middle] + at]
                right = (word <= sought[active]) if after else (word < sought[active])
                a[active[right]] = middle[right] + 1
                b[active[~right]] = middle[~right]
            found.append(a)
        return found

    def windows(self, items: Items):
        """Test suffixes whose window occurs, and the range of suffixes that begin with it."""
        queries = np.flatnonzero(items.windows)
        ordered = self.words[self.order]
        low = np.searchsorted(ordered, items.words[queries], "left")
        high = np.searchsorted(ordered, items.words[queries], "right")
        done = []
        at = 1
        while True:
            alive = low < high
            queries, low, high = queries[alive], low[alive], high[alive]
            over = items.windows[queries] == at
            done.append((queries[over], low[over], high[over]))
            queries, low, high = queries[~over], low[~over], high[~over]
            if not len(queries):
                break
            low, high = self.narrowed(low, high, at, items.words[queries + at])
            at += 1
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def longest(self, items: Items, queries, low, high):
        """For test suffixes with a window in these ranges: their longest match and its place."""
        if not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = prefix_sums(self.words)
        inverse = powers(max(len(sums), len(items.sums)))[1]

        def common(places: np.ndarray, which: np.ndarray) -> np.ndarray:
            least = np.zeros(len(places), np.int64)
            most = np.minimum(len(self.words) - places, items.ends[which] - which)
            while (least < most).any():
                half = (least + most + 1) // 2
                same = (sums[places + half] - sums[places]) * inverse[places] == (
                    items.sums[which + half] - items.sums[which]
                ) * inverse[which]
                least, most = np.where(same, half, least), np.where(same, most, half - 1)
            return least

        a, b = low.copy(), high.copy()
        while True:
            active = np.flatnonzero(a < b)
            if not len(active):
                break
            middle = (a[active] + b[active]) // 2
            places, which = self.order[middle], queries[active]
            same = common(places, which)
            over = same == items.ends[which] - which
            word = self.words[np.minimum(places + same, len(self.words) - 1)]
            smaller = ~over & (word < items.words[np.minimum(which + same, len(items.words) - 1)])
            a[active[smaller]] = middle[smaller] + 1
            b[active[~smaller]] = middle[~smaller]
        best, where = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for near in (a - 1, a):
            near = np.clip(near, low, high - 1)
            same = common(self.order[near], queries)
            where = np.where(same > best, self.order[near], where)
            best = np.maximum(best, same)
        return best, where


def shard_report(words: np.ndarray, first: np.ndarray, items: Items):
    """Per text: runs of hit words, the items, and the longest matches that lie in it."""
    texts = len(first) - 1
    hits: list[list] = [[] for _ in range(texts)]
    found: list[list] = [[] for _ in range(texts)]
    matches: list[list] = [[] for _ in range(texts)]
    if not len(words) or not len(items.words):
        return hits, found, matches
    shard = Shard.of(words, first, items.depth)
    queries, low, high = shard.windows(items)
    if not len(queries):
        return hits, found, matches
    counts = high - low
    skipped = np.cumsum(counts) - counts
    places = shard.order[np.repeat(low - skipped, counts) + np.arange(counts.sum())]
    covered = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(covered, places, 1)
    np.add.at(covered, places + np.repeat(items.windows[queries], counts), -1)
    hit = np.cumsum(covered[:-1]) > 0
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for owner, a, b in zip((np.searchsorted(shard.first, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
        base = int(shard.first[owner])
        hits[owner].append({"start": a - base, "end": b - base})
    owners = np.searchsorted(shard.first, places, "right") - 1
    pairs = np.unique(owners * len(items.ids) + np.repeat(items.owners[queries], counts))
    for owner, item in zip((pairs // len(items.ids)).tolist(), (pairs % len(items.ids)).tolist(), strict=True):
        if items.ids[item] is not None:
            found[owner].append(items.ids[item])
    best, where = shard.longest(items, queries, low, high)
    owners = np.searchsorted(shard.first, where, "right") - 1
    for query, owner, length, place in zip(queries.tolist(), owners.tolist(), best.tolist(), where.tolist(), strict=True):
        matches[owner].append(
            {
                "item_id": items.ids[items.owners[query]],
                "offset": int(items.offsets[query]),
                "length": length,
                "start": place - int(shard.first[owner]),
            }
        )
    return hits, [sorted(set(x)) for x in found], matches


def _report_of_block(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    match = pa.struct([("item_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("start", pa.int64())])
    schema = pa.schema(
        [
            ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
            ("hits", pa.list_(run)), ("item_ids", pa.list_(pa.string())), ("matches", pa.list_(match)),
        ]
    )

    def report(batches):
        for rows, data, bounds in text_slices(batches, "text", SHARD_BYTES):
            words, first = hashed_words(data, bounds)
            hits, found, matches = shard_report(words, first, shared.value)
            columns = (rows.column("row"), rows.column("doc_id"), np.diff(first), hits, found, matches)
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")
    )
    return read.mapInArrow(report, REPORT)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``REPORT`` for every row of ``docs``: hit words, items, and longest matches.

    ``hits`` are disjoint runs of words covered by occurring windows, ``item_ids`` the distinct
    items with such windows in order, ``matches`` for test suffixes the longest verbatim match
    in the shard where it lies in this document (``longest_matches`` takes the corpus-wide
    longest). Null or empty texts have no words; rows with null or repeated ids keep their own
    row; repeated items count once and items without an id mark words but are not listed.
    Without items nothing is hit. Other columns are not read.
    """
    reports = [_report_of_block(docs, items) for items in item_blocks(benchmark, window)]
    if not reports:
        reports = [_report_of_block(docs, items_of([], window))]
    if len(reports) == 1:
        return reports[0]
    every = reports[0]
    for report in reports[1:]:
        every = every.unionByName(report)
    merged = every.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    # Runs in order of their start: each begins where those before it have ended.
    end = "CAST(0 AS BIGINT)"
    joined = f"""transform(filter(aggregate(runs, struct({end} AS reach, CAST(array() AS array<struct<start:bigint,end:bigint>>) AS kept),
        (a, r) -> struct(greatest(a.reach, r.end) AS reach,
            array_append(a.kept, named_struct('start', greatest(a.reach, r.start), 'end', greatest(a.reach, r.end))) AS kept)).kept,
        r -> r.end > r.start), r -> r)"""
    return merged.select("row", "doc_id", "n_words", F.expr(joined).alias("hits"), "item_ids", "matches")


def longest_matches(report: DataFrame) -> DataFrame:
    """For each test suffix with an occurring window its longest match and one location."""
    match = report.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    place = F.struct("length", (-F.col("start")).alias("s"), "doc_id", "start")
    best = match.groupBy("item_id", "offset").agg(F.max(place).alias("best"))
    return best.select("item_id", "offset", "best.length", "best.doc_id", "best.start")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs.

    Null and empty texts, and all texts where there are no items, stay; repeated rows and null
    ids stay or go one by one.
    """
    kept = docs
    for items in item_blocks(benchmark, window):
        kept = _without_hits(kept, items)
    return kept


def _without_hits(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def clean(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        hits, _, _ = shard_report(*hashed_words(data, bounds), shared.value)
        return np.array([not x for x in hits], bool)

    return docs.filter(where_text(clean, SHARD_BYTES))


def digest_columns(report: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return report.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def oracle_sql(window: int = WINDOW) -> str:
    words = """regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id, {words} AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[k + 1 : k + least(len(w), {window})], ' ') AS s
      FROM b, unnest(range(len(w) - least(len(w), {window}) + 1)) AS t(k) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM windows),
    spans AS (
      SELECT doc_id, k, n, array_to_string(w[k + 1 : k + n], ' ') AS s
      FROM d, sizes, unnest(range(len(w) - n + 1)) AS t(k)),
    found AS (SELECT doc_id, k, n, item_id FROM spans JOIN windows USING (n, s)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
    items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
      array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM found GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
