"""Product codes of vectors: k-means by metric trees, built middle-out from anchors.

Every block of vectors has a tree of balls for each part position. A ball caches the sum and the
number of its points. A round sends the list of entries down the trees; a ball drops entries
that none of its points can be nearest to, and hands the rest on to its halves. Where a single
entry is left, the cached sum counts for all points at once. All distances that decide are whole
numbers, so results are exact and do not depend on how vectors are dealt to blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK_ROWS = 2048
LEAF_ROWS = 32
# Whole components stay below this, so that squared distances are exact as doubles.
LARGEST = 1 << 20


@dataclass
class Tree:
    """Points in the order of the leaves; ball k holds those from ``low[k]`` to ``high[k]``."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    halves: np.ndarray
    sums: np.ndarray
    radii: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in _TREE.items()}


# Names and number types of a stored tree's arrays.
_TREE = {"points": "<i4", "order": "<i4", "low": "<i4", "high": "<i4", "halves": "<i4", "sums": "<i8", "radii": "<f8"}


def _unpacked(stored_tree: dict[str, bytes], width: int) -> Tree:
    found = {name: np.frombuffer(stored_tree[name], kind) for name, kind in _TREE.items()}
    for name, columns in (("points", width), ("sums", width), ("halves", 2)):
        found[name] = found[name].reshape(-1, columns).astype(np.int64)
    return Tree(**found)


def _owners(points: np.ndarray, count: int) -> np.ndarray:
    """Which of up to ``count`` anchors each point belongs to.

    The next anchor is the point farthest from its own; it takes the points that are nearer to
    it. A point at most half as far from its anchor as the new one is, cannot be.
    """
    owner = np.zeros(len(points), np.int64)
    anchors = points[:1]
    far = np.sqrt(((points - anchors[0]) ** 2).sum(1))
    for number in range(1, count):
        new = points[int(far.argmax())]
        if far.max() == 0:
            break
        half = np.sqrt(((anchors - new) ** 2).sum(1)) / 2
        some = np.flatnonzero(far > half[owner])
        distance = np.sqrt(((points[some] - new) ** 2).sum(1))
        nearer = distance < far[some]
        owner[some[nearer]], far[some[nearer]] = number, distance[nearer]
        anchors = np.vstack([anchors, new])
    return owner


def _middle_out(points: np.ndarray, rows: np.ndarray):
    """A nested pair of halves, or the rows of a leaf."""
    if len(rows) <= LEAF_ROWS:
        return rows
    owner = _owners(points[rows], int(np.sqrt(len(rows))) + 1)
    groups = [rows[owner == k] for k in range(int(owner.max()) + 1)]
    groups = [g for g in groups if len(g)]
    if len(groups) == 1:
        return rows
    centres = np.array([points[g].mean(0) for g in groups])
    radii = np.array([np.sqrt(((points[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centres, strict=True)])
    sizes = np.array([len(g) for g in groups], float)
    nodes = [_middle_out(points, g) for g in groups]

    def merged(one: int, others: np.ndarray) -> np.ndarray:
        """Radii of the balls around two balls each."""
        weight = sizes[others] / (sizes[one] + sizes[others])
        apart = np.sqrt(((centres[others] - centres[one]) ** 2).sum(1))
        return np.maximum(apart * weight + radii[one], apart * (1 - weight) + radii[others])

    every = np.arange(len(nodes))
    cost = np.array([merged(k, every) for k in every])
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(nodes) - 1):
        one, other = (int(x) for x in np.unravel_index(int(cost.argmin()), cost.shape))
        radius = cost[one, other]
        nodes[one] = (nodes[one], nodes[other])
        centres[one] = (centres[one] * sizes[one] + centres[other] * sizes[other]) / (sizes[one] + sizes[other])
        sizes[one] += sizes[other]
        radii[one] = radius
        cost[other], cost[:, other] = np.inf, np.inf
        alive = np.flatnonzero(np.isfinite(cost[one]))
        cost[one, alive] = cost[alive, one] = merged(one, alive)
    return nodes[one]


def build_tree(points: np.ndarray) -> Tree:
    """The metric tree of whole-number ``points``, halves after the balls that they halve."""
    root = _middle_out(points.astype(float), np.arange(len(points)))
    order, balls = [], []

    def place(node) -> int:
        number = len(balls)
        balls.append([len(order), 0, -1, -1])
        if isinstance(node, tuple):
            balls[number][2:] = [place(half) for half in node]
        else:
            order.extend(node.tolist())
        balls[number][1] = len(order)
        return number

    place(root)
    shape, order = np.array(balls), np.array(order, np.int64)
    low, high = shape[:, 0], shape[:, 1]
    placed = points[order].astype(np.int64)
    before = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(placed, 0)])
    sums = before[high] - before[low]
    centres = sums / (high - low)[:, None]
    radii = np.array([np.sqrt(((placed[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(low, high, centres, strict=True)])
    return Tree(placed, order, low, high, shape[:, 2:], sums, radii)


def owned(tree: Tree, entries: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """What belongs to which of ``entries``: whole balls, then single points, each point once.

    An entry is dropped from a ball's list where the ball lies wholly on the nearer side of the
    plane between it and the entry nearest to the centre, by a margin beyond rounding. Of equal
    entries only the first can be nearest.
    """
    spread = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    first = ~np.tril(spread == 0, -1).any(1)
    apart = np.sqrt(spread)
    balls, lists = np.zeros(1, np.int64), first[None, :]
    while len(balls):
        centres = tree.sums[balls] / (tree.high[balls] - tree.low[balls])[:, None]
        distance = ((centres[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        distance[~lists] = np.inf
        best = distance.argmin(1)
        lead = distance - distance[np.arange(len(balls)), best][:, None]
        reach = 2 * apart[best] * tree.radii[balls][:, None]
        lists = lists & (lead <= reach * (1 + 1e-9) + 1e-3)
        whole = lists.sum(1) == 1
        if whole.any():
            yield "balls", balls[whole], best[whole]
        leaf = ~whole & (tree.halves[balls, 0] < 0)
        if leaf.any():
            sizes = tree.high[balls[leaf]] - tree.low[balls[leaf]]
            ends = np.cumsum(sizes)
            rows = np.repeat(tree.low[balls[leaf]] - (ends - sizes), sizes) + np.arange(ends[-1])
            exact = squared(tree.points[rows], entries)
            exact[~np.repeat(lists[leaf], sizes, 0)] = np.inf
            yield "points", rows, exact.argmin(1)
        inner = ~whole & ~leaf
        balls, lists = tree.halves[balls[inner]].ravel(), np.repeat(lists[inner], 2, 0)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact as all terms are whole numbers below 2^53."""
    points, entries = points.astype(float), entries.astype(float)
    return (points**2).sum(1)[:, None] + (entries**2).sum(1)[None, :] - 2 * (points @ entries.T)


def _totals(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """Per entry the number of its points and their sum, from cached sums where balls are owned."""
    totals = np.zeros((len(entries), 1 + entries.shape[1]), np.int64)
    for kind, which, owner in owned(tree, entries):
        if kind == "balls":
            found = np.column_stack([tree.high[which] - tree.low[which], tree.sums[which]])
        else:
            found = np.column_stack([np.ones(len(which), np.int64), tree.points[which]])
        np.add.at(totals, owner, found)
    return totals


def _codes(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's entry and squared distance, in the order of the block's rows."""
    found = np.empty(len(tree.points), np.int64)
    for kind, which, owner in owned(tree, entries):
        if kind == "balls":
            for ball, entry in zip(which.tolist(), owner.tolist(), strict=True):
                found[tree.low[ball] : tree.high[ball]] = entry
        else:
            found[which] = owner
    errors = ((tree.points - entries[found]) ** 2).sum(1)
    codes = np.empty_like(found)
    codes[tree.order], back = found, np.empty_like(errors)
    back[tree.order] = errors
    return codes, back


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, whole``: usable vectors with whole components, all of one length.

    Their length is that of the vector with the smallest id. Vectors that are null or empty,
    hold null or non-finite components, or have another length, drop out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = embeddings.filter((F.size("embedding") > 0) & finite)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("whole")
    read = usable.select(F.col("vec_id").cast("long"), "label", whole)
    least = read.orderBy(F.asc_nulls_last("vec_id"), "whole").select(F.size("whole").alias("width")).first()
    if least is None:
        return read
    if least.width % PARTS:
        raise ValueError(f"vectors of {least.width} components can't be cut into {PARTS} equal parts")
    same = read.filter(F.size("whole") == least.width)
    bounded = F.forall("whole", lambda x: F.abs(x) < LARGEST)
    checked = F.when(bounded, F.col("whole")).otherwise(
        F.raise_error(F.lit(f"a component times {SCALE} is {LARGEST} or more")).cast("array<bigint>")
    )
    return same.withColumn("whole", checked)


def trees(vectors: DataFrame, width: int) -> DataFrame:
    """Blocks of vectors with a tree per part position, stored for all rounds."""
    tree_type = pa.struct([(name, pa.binary()) for name in _TREE])
    names = ", ".join(f"{name}: binary" for name in _TREE)
    kind = vectors.schema["label"].dataType.simpleString()

    def build(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(low, BLOCK_ROWS)
                whole = rows.column("whole").flatten().to_numpy().reshape(rows.num_rows, PARTS, width)
                built = [build_tree(whole[:, part]).packed() for part in range(PARTS)]
                ids, labels = (pa.array([rows.column(n).to_pylist()], pa.list_(rows.column(n).type)) for n in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([built], pa.list_(tree_type))], ["ids", "labels", "trees"]
                )

    return stored(vectors.mapInArrow(build, f"ids array<long>, labels array<{kind}>, trees array<struct<{names}>>"), "trees")


def _next_entries(blocks: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries without points stay.

    A task adds up all its blocks, so that it sends one number per component of the codebooks.
    """
    width = entries.shape[2]
    schema = pa.schema([("place", pa.int64()), ("total", pa.int64())])

    def add(batches):
        totals = np.zeros((*entries.shape[:2], 1 + width), np.int64)
        for batch in batches:
            for found in batch.column("trees").to_pylist():
                for part, tree in enumerate(found):
                    totals[part] += _totals(_unpacked(tree, width), entries[part])
        flat = totals.ravel()
        yield batch_of(schema, np.arange(len(flat)), flat)

    sums = blocks.select("trees").mapInArrow(add, "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
    rows = sums.toArrow()
    totals = np.zeros(entries.shape[0] * entries.shape[1] * (1 + width), np.int64)
    totals[rows["place"].to_numpy()] = rows["total"].to_numpy()
    totals = totals.reshape(*entries.shape[:2], 1 + width)
    used = totals[:, :, :1] > 0
    return np.where(used, totals[:, :, 1:] // np.maximum(totals[:, :, :1], 1), entries)


def codebooks(vectors: DataFrame, blocks: DataFrame, width: int, rounds: int = ROUNDS, count: int = ENTRIES) -> np.ndarray:
    """Entries by part, from the ``count`` smallest ids on; of equal ids the smaller vector first."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "whole").limit(count).collect()
    whole = np.array([x.whole for x in first], np.int64).reshape(len(first), PARTS, width)
    entries = whole.transpose(1, 0, 2)
    for _ in range(rounds):
        entries = _next_entries(blocks, entries)
    return entries


def codebook_digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, rounds: int = ROUNDS, count: int = ENTRIES) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector.

    See ``whole_vectors`` for what is dropped. Repeated rows give rows of their own, and a null
    id comes after all others; null labels are one label; further columns are not read. With
    fewer vectors than ``count``, codebooks have as many entries as there are vectors. No
    vectors give no rows. Raises where a component is too large to be counted exactly.
    """
    vectors = whole_vectors(embeddings)
    first = vectors.select(F.size("whole").alias("width")).first()
    width = first.width // PARTS if first else 1
    blocks = trees(vectors, width)
    entries = codebooks(vectors, blocks, width, rounds, count)
    digest = codebook_digest(entries)
    kind = vectors.schema["label"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            for number, found in enumerate(batch.column("trees").to_pylist()):
                parts = [_codes(_unpacked(tree, width), entries[part]) for part, tree in enumerate(found)]
                codes = np.column_stack([x for x, _ in parts]).astype(np.uint8)
                errors = np.sum([x for _, x in parts], 0)
                ids, labels = (batch.column(n).slice(number, 1).flatten() for n in ("ids", "labels"))
                hexes = pa.array([x.tobytes().hex() for x in codes])
                yield pa.RecordBatch.from_arrays([ids, labels, hexes, pa.array(errors)], ["vec_id", "label", "code", "error"])

    coded = stored(blocks.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long"), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    placed = coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    return placed.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same rows in DuckDB: every part against every entry of its codebook."""

    def assigned(name: str, books: str) -> str:
        square = "(v.w[i] - c.w[i]) * (v.w[i] - c.w[i])"
        return f"""
    {name} AS (
      SELECT n, vec_id, label, p, any_value(v.w) AS w, min(list_sum(list_transform(range(1, len(v.w) + 1), lambda i: {square}))::BIGINT * {ENTRIES} + e) AS key
      FROM parts v JOIN {books} c USING (p) GROUP BY n, vec_id, label, p)"""

    def renewed(name: str, books: str, found: str) -> str:
        return f"""
    {name}_sums AS (
      SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS k
      FROM (SELECT p, key % {ENTRIES} AS e, unnest(w) AS x, unnest(range(len(w))) AS i FROM {found}) GROUP BY ALL),
    {name} AS (
      SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM {books} b LEFT JOIN (
        SELECT p, e, list((s - ((s % k) + k) % k) // k ORDER BY i) AS w FROM {name}_sums GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""

    return f"""
    WITH kept AS (
      SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    parts AS (
      SELECT n, vec_id, label, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS w
      FROM (SELECT *, unnest(range({PARTS})) AS p FROM kept)),
    b0 AS (SELECT p, n AS e, w FROM parts WHERE n < {ENTRIES}),
    {assigned("a0", "b0")},
    {renewed("b1", "b0", "a0")},
    {assigned("a1", "b1")},
    {renewed("b2", "b1", "a1")},
    {assigned("a2", "b2")},
    digest AS (
      SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) AS codebooks_sha256
      FROM (SELECT p, e, unnest(w)::VARCHAR AS x, unnest(range(len(w))) AS i FROM b2)),
    coded AS (
      SELECT n, vec_id, label, string_agg(printf('%02x', key % {ENTRIES}), '' ORDER BY p) AS code, sum(key // {ENTRIES})::BIGINT AS error
      FROM a2 GROUP BY n, vec_id, label)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""
