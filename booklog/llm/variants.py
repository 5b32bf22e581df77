"""Spelling variants: words one edit apart, found through products of letter-count blocks.

Words are vectors of letter counts. Two words one edit apart have vectors with a squared
distance of at most two, and lie in the same or in neighbouring cells of coarser counts, which
include the length. Tiles of neighbouring cells are multiplied as matrices; pairs that pass are
verified letter by letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, stored, text_bounds, whole_text

# What a run consists of, the period of the deletions, the least length and count.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
PERIOD = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
TIMES = 2
# Letters are dealt to this many groups; a cell is the number of letters of each group.
GROUPS = 6
TILE_ROWS = 1024
# Words of some tile pairs at a time, and letters of some word pairs.
SLICE_WORDS = 1 << 15
STEP_LETTERS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = 26 + 64


def word_counts(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """``word, n``: the words of all texts that are long and frequent enough.

    Counts are combined before they are shuffled. A null id deletes nothing.
    """
    runs = F.explode(F.regexp_extract_all(whole_text(), F.lit(RUN), F.lit(0))).alias("run")
    lower = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc"), runs).select(
        "doc", F.translate("run", _UPPER, _LOWER).alias("run")
    )
    size = F.char_length("run")
    hashed = lower.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = hashed.select(F.when(F.col("h") % period == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _cell() -> Column:
    """The numbers of letters of each group, as an array."""
    alphabet = _LOWER + "".join(map(chr, range(0xC0, 0x100)))
    size = F.char_length("word")
    counts = [size - F.char_length(F.translate("word", alphabet[k::GROUPS], "")) for k in range(GROUPS)]
    return F.array(*counts)


def _shifts() -> list[list[int]]:
    """From a cell to those that an edit may lead to, each pair of cells once.

    Nothing changes, a letter of one group more, or one of a group gives way to one of a later.
    """
    unit = np.eye(GROUPS, dtype=int)
    found = [np.zeros(GROUPS, int), *unit]
    found += [unit[b] - unit[a] for a in range(GROUPS) for b in range(a + 1, GROUPS)]
    return [x.tolist() for x in found]


def _tiles(words: DataFrame) -> DataFrame:
    """``cell, tile, listed``: the words of a cell in tiles of about ``TILE_ROWS``, dealt by hash."""
    celled = words.select("word", "n", _cell().alias("cell"))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("tiles"))
    dealt = celled.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    return dealt.groupBy("cell", "tile").agg(F.collect_list(F.struct("word", "n")).alias("listed"))


class Spelled:
    """The words of many tiles as letters one after the other; all are below U+0100."""

    def __init__(self, tiles: pa.ListArray):
        listed = tiles.flatten()
        self.words, self.n = listed.field("word"), listed.field("n")
        self.edges = np.append(0, np.cumsum(tiles.value_lengths().to_numpy()))
        data, bounds = text_bounds(self.words)
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        kept = data != 0xC3
        before = np.append(0, np.cumsum(kept))
        # Letters beyond ASCII have the lead byte C3, and a second byte 0x40 below their number.
        self.letters = np.where(data < 0x80, data, data + np.uint8(0x40))[kept]
        self.starts = before[bounds[:-1]]
        self.sizes = np.diff(before[bounds])

    def counts(self) -> np.ndarray:
        """A row of letter counts per word."""
        letter = np.where(self.letters < 0xC0, self.letters - np.int64(ord("a")), self.letters - np.int64(0xC0 - 26))
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        flat = np.bincount(row * _LETTERS + letter, minlength=len(self.sizes) * _LETTERS)
        return flat.reshape(len(self.sizes), _LETTERS).astype(np.float32)

    def padded(self, which: np.ndarray, width: int, at_end: bool) -> np.ndarray:
        """Letters of some words in rows, zeros after them or before them."""
        place = np.arange(width)[None, :] - (width - self.sizes[which] if at_end else np.zeros(len(which), int))[:, None]
        inside = (place >= 0) & (place < self.sizes[which][:, None])
        return np.where(inside, self.letters[np.where(inside, self.starts[which][:, None] + place, 0)], 0)


def one_edit(one: Spelled, a: np.ndarray, other: Spelled, b: np.ndarray) -> np.ndarray:
    """Which words ``a`` become words ``b`` by one inserted, deleted or replaced letter.

    What both have in common at the start and at the end leaves one letter of the longer word.
    """
    verified = np.zeros(len(a), bool)
    longest = np.maximum(one.sizes[a], other.sizes[b])
    order, low = np.argsort(longest, kind="stable"), 0
    while low < len(a):
        high = low + max(1, min(len(a) - low, STEP_LETTERS // int(longest[order[min(low + 4096, len(a) - 1)]])))
        some = order[low : min(high, low + 4096)]
        x, y, width = a[some], b[some], int(longest[some].max())
        shorter = np.minimum(one.sizes[x], other.sizes[y])
        common = np.zeros(len(some), np.int64)
        for at_end in (False, True):
            equal = one.padded(x, width, at_end) == other.padded(y, width, at_end)
            if at_end:
                equal = equal[:, ::-1]
            common += np.minimum(np.where(equal.all(1), width, equal.argmin(1)), shorter)
        same = common >= 2 * shorter
        apart = longest[some] - shorter
        verified[some] = (apart <= 1) & (common >= longest[some] - 1) & ~((apart == 0) & same)
        low += len(some)
    return verified


def close_pairs(one: Spelled, other: Spelled, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are one edit apart, in tile k of either side; each pair once."""
    x, y = one.counts(), other.counts()
    x_square, y_square = (x * x).sum(1), (y * y).sum(1)
    found = []
    for k in range(len(same)):
        p, q = slice(*one.edges[k : k + 2]), slice(*other.edges[k : k + 2])
        close = x_square[p, None] + y_square[None, q] - 2 * (x[p] @ y[q].T) <= 2
        if same[k]:
            close = np.triu(close, 1)
        a, b = np.nonzero(close)
        found.append((a + one.edges[k], b + other.edges[k]))
    a, b = (np.concatenate([pair[side] for pair in found]) for side in (0, 1))
    verified = one_edit(one, a, other, b)
    return a[verified], b[verified]


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: for each of ``words (word, n)`` all words one edit apart.

    A tile meets those of its own cell and of the neighbouring ones, by joins on the cell. A
    word has at most a few thousand possible neighbours, so no group here grows with the data.
    """
    tiles = stored(_tiles(words), "word-tiles")
    shifts = F.array(*[F.array(*map(F.lit, x)) for x in _shifts()])
    moved = F.transform(shifts, lambda s: F.zip_with("cell", s, lambda a, b: a + b))
    left = tiles.select(
        F.col("cell").alias("own"), F.col("tile").alias("own_tile"), F.col("listed").alias("one"), F.explode(moved).alias("cell")
    )
    met = left.join(tiles, "cell").filter("cell != own OR own_tile <= tile")
    same = ((F.col("cell") == F.col("own")) & (F.col("own_tile") == F.col("tile"))).alias("same")
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def multiply(batches):
        for batch in batches:
            sizes = sum(batch.column(n).value_lengths().to_numpy() for n in ("one", "other"))
            low = 0
            while low < batch.num_rows:
                some = int(np.searchsorted(np.cumsum(sizes[low:]), SLICE_WORDS, "right")) or 1
                rows = batch.slice(low, some)
                low += some
                one, other = Spelled(rows.column("one")), Spelled(rows.column("other"))
                a, b = (pa.array(x) for x in close_pairs(one, other, rows.column("same").to_numpy(zero_copy_only=False)))
                if len(a):
                    yield batch_of(schema, one.words.take(a), other.words.take(b), other.n.take(b))
                    yield batch_of(schema, other.words.take(b), one.words.take(a), one.n.take(a))

    pairs = met.select("one", F.col("listed").alias("other"), same)
    return pairs.mapInArrow(multiply, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form, by doubling steps.

    A form has at least twice its word's count, so chains have no cycle and a length below the
    binary logarithm of the largest count.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = stored(
            steps.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.expr("beyond IS NOT NULL").alias("moved")),
            "variant-roots",
        )
        if steps.filter("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.drop("moved")


def spelling_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs (doc_id, text)``.

    Words are runs of letters in lower case, some with a letter deleted as the hash of document
    and run says, that have five letters and three occurrences at least. A word's form is its
    most frequent neighbour, the first in code-point order among equals, if it has ``times`` the
    word's occurrences. Null and empty texts have no words; a null id deletes nothing; repeated
    rows count again; further columns are not read. No words give no rows.
    """
    words = stored(word_counts(docs), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = stored(words.join(near, "word", "left"), "variant-forms")
    n = -F.col("best.less")
    is_form = n >= times * F.col("n")
    formed = known.select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, n).alias("form_n"),
    )
    roots = _roots(formed.filter("form IS NOT NULL"))
    rooted = formed.join(roots, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """The same rows in DuckDB: checksums bit by bit, neighbours by deleted letters."""
    return f"""
    WITH RECURSIVE bits AS (
      SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
      UNION ALL
      SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
    runs AS (
      SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS raw FROM documents),
    lowered AS (
      SELECT doc_id, translate(raw, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n FROM runs GROUP BY ALL),
    bytes AS (
      SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS h FROM lowered),
    hashed AS (
      SELECT doc_id, run, n, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 1 + 2 * i, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS crc
      FROM bytes, tab),
    spelled AS (
      SELECT CASE WHEN crc % {PERIOD} = 0
        THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word, n
      FROM hashed),
    words AS (
      SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
    holes AS (
      SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    pairs AS (
      SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
      UNION
      SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
      UNION
      SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
    best AS (
      SELECT word, count(*) AS n_near, max(near_n) AS top, min(near) FILTER (near_n = m) AS near
      FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS m FROM pairs) GROUP BY word),
    formed AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {TIMES} * w.n THEN near END AS form,
        CASE WHEN top >= {TIMES} * w.n THEN top END AS form_n
      FROM words w LEFT JOIN best USING (word)),
    paths AS (
      SELECT word, word AS root FROM formed
      UNION ALL
      SELECT p.word, f.form FROM paths p JOIN formed f ON f.word = p.root WHERE f.form IS NOT NULL),
    ends AS (
      SELECT p.word, p.root FROM paths p JOIN formed f ON f.word = p.root WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
