"""Near-duplicate vectors by cosine, with tiles compared along principal axes.

Equal vectors of a label are first reduced to one, with their number. The others are
turned to their principal axes (about the origin, as cosines are), which changes no
product and puts most of a vector's length into its first components. The vectors of a
label are cut into tiles along the first axis; two tiles meet in a task of their own,
unless the boxes around them are further apart than any linked pair can be. There the
products are added up over the leading components first. What the others can still add
is at most the product of the norms of both rests; pairs that cannot reach the threshold
are given up, and a block without any pair left is not followed further.

A task returns a row for each vector that has links there: how many, and one link of a
forest, not all pairs. So a large group of copies costs little more than its vectors.
The comparisons themselves grow with the square of a label, as an exact search must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import discard, materialise, meet, scratch
from orbweave.llm.simhash_dedup import components

THRESHOLD = 0.93
#: Products this close to the threshold are computed anew from the vectors as they came.
CLOSE = 1e-9
#: Bytes of a tile's vectors as doubles, and the rows from which a label is cut in two (four tiles at most for that reason alone).
TILE_BYTES = 1 << 24
SPREAD_ROWS = 2_048
#: Leading components that tiles have boxes of, and cells of the first axis from -1 to 1.
LEAD = 4
CELLS = 256
#: Widths, the most frequent ones, for which principal axes are found; vectors of others keep their own.
MOST_WIDTHS = 8
#: Rows of either side that are compared at once, and the share of pairs left below which they are listed.
ROWS = 1_024
FEW = 1 / 16


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows with length 1; a power of two first, so that no square under- or overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` to those of ``b`` at the same place, from the vectors as they came."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def steps(width: int) -> list[int]:
    """Where the products are looked at: after an eighth of the components, a quarter, and so on."""
    return sorted({min(width, max(1, -(-width * k // 8))) for k in (1, 2, 3, 4, 6, 8)})


class Tile:
    """Vectors turned to the axes, with the norms of what is left after each step."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray | None):
        self.own = vectors
        unit = unit_rows(vectors) if len(vectors) else vectors
        self.turned = unit if axes is None else unit @ axes.T
        after = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {k: np.sqrt(after[:, k]) if k < vectors.shape[1] else np.zeros(len(vectors)) for k in steps(vectors.shape[1])}


def linked(a: Tile, b: Tile, rows: slice, columns: slice, threshold: float = THRESHOLD) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Which rows of ``a`` and of ``b`` have a cosine of at least ``threshold``: a matrix of flags, or their places if few."""
    x, y = a.turned[rows], b.turned[columns]
    least, begin = threshold - CLOSE, 0
    products: np.ndarray | float = 0.0
    pairs = None
    for end in steps(x.shape[1]):
        if pairs is None:
            products = products + x[:, begin:end] @ y[:, begin:end].T
            alive = products + np.outer(a.rest[end][rows], b.rest[end][columns]) >= least
            n = int(alive.sum())
            if not n:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if n <= FEW * alive.size:
                pairs = np.nonzero(alive)
                products = products[pairs]
        else:
            i, j = pairs
            products = products + (x[i, begin:end] * y[j, begin:end]).sum(1)
            alive = products + a.rest[end][rows][i] * b.rest[end][columns][j] >= least
            pairs, products = (i[alive], j[alive]), products[alive]
            if not len(products):
                return pairs
        begin = end
    close = np.abs(products - threshold) <= CLOSE
    found = products >= threshold
    i, j = np.nonzero(close) if pairs is None else (p[close] for p in pairs)
    if len(i):
        found[close] = cosines(a.own[rows][i], b.own[columns][j]) >= threshold
    return found if pairs is None else (pairs[0][found], pairs[1][found])


class Forest:
    """Sets of numbers that links have joined; the least number stands for a set."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, k: int) -> int:
        while self.above[k] != k:
            self.above[k] = k = self.above[self.above[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)


def _stars(flags: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Links that join what a dense matrix of links joins: rows (and columns, True) to the row that stands for them."""
    n = len(flags)
    row, column = np.where(flags.any(1), np.arange(n), n), np.full(flags.shape[1], n)
    while True:  # each takes the least number around it until nothing changes
        column = np.minimum(column, np.where(flags, row[:, None], n).min(0))
        new = np.minimum(row, np.where(flags, column[None, :], n).min(1))
        if (new == row).all():
            break
        row = new
    for k in np.flatnonzero((row < n) & (row != np.arange(n))).tolist():
        yield int(row[k]), k, False
    for k in np.flatnonzero(column < n).tolist():
        yield int(column[k]), k, True


def compare(a: np.ndarray, b: np.ndarray | None, copies_a: np.ndarray, copies_b: np.ndarray | None, axes: np.ndarray | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of ``a`` and then of ``b`` (None: ``a`` with itself): the weighted number of links, and the set each is in (the least place)."""
    alone = b is None
    left = Tile(a, axes)
    right = left if alone else Tile(b, axes)
    weight_b, shift = (copies_a, 0) if alone else (copies_b, len(a))
    counts = np.zeros(len(a) + (0 if alone else len(b)), np.int64)
    sets = Forest(len(counts))
    for i in range(0, len(a), ROWS):
        rows = slice(i, min(i + ROWS, len(a)))
        for j in range(i if alone else 0, len(right.own), ROWS):
            columns = slice(j, min(j + ROWS, len(right.own)))
            found = linked(left, right, rows, columns, threshold)
            if isinstance(found, tuple):
                p, q = found
                if alone and i == j:
                    p, q = p[p < q], q[p < q]
                np.add.at(counts, i + p, weight_b[j + q])
                np.add.at(counts, shift + j + q, copies_a[i + p])
                for x, y in zip((i + p).tolist(), (shift + j + q).tolist(), strict=True):
                    sets.join(x, y)
            else:
                if alone and i == j:
                    found = np.triu(found, 1)
                counts[rows] += found @ weight_b[columns]
                counts[shift + j : shift + columns.stop] += found.T @ copies_a[rows]
                for x, y, other in _stars(found):
                    sets.join(i + x, shift + j + y if other else i + y)
    return counts, np.array([sets.root(k) for k in range(len(counts))], np.int64)


def _gram(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (rows) of the most frequent widths, from the sum of products of all unit vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, x, _ in _by_width(batch.column(0)):
                unit = unit_rows(x)
                sums[width] = sums.get(width, 0.0) + unit.T @ unit
        for width, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(list(m))], names=["width", "row", "part"])

    widths = [r.width for r in vectors.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(MOST_WIDTHS).collect()]
    common = vectors.where(F.col("width").isin(widths))
    parts = common.select("embedding").mapInArrow(add, "width int, row int, part array<double>")
    whole = parts.select("width", "row", F.posexplode("part").alias("at", "x")).groupBy("width", "row", "at").agg(F.sum("x").alias("x"))
    grams = {w: np.zeros((w, w)) for w in widths}
    for r in whole.toLocalIterator():  # a square matrix a width
        grams[r.width][r.row, r.at] = r.x
    return {w: np.linalg.eigh(m)[1][:, ::-1].T for w, m in grams.items()}


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a list column by their width: the width, the vectors as doubles and their places."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.r_[0, np.cumsum(sizes)]
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        yield width, flat[begins[at][:, None] + np.arange(width)[None, :]], at


def _placed(vectors: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with ``lead``, their first components on the axes, and ``cell``, the place on the first axis."""
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    at = vectors.columns.index("embedding")
    schema = T.StructType([*vectors.schema.fields, T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = np.zeros((len(batch), LEAD))
            for width, x, rows in _by_width(batch.column(at)):
                turned = unit_rows(x)
                n = min(LEAD, width)
                lead[rows, :n] = turned[:, :n] if width not in shared.value else turned @ shared.value[width][:n].T
            cells = np.clip(np.floor((lead[:, 0] + 1) / 2 * CELLS), 0, CELLS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lead), pa.list_(pa.float64())), pa.array(cells)], names=schema.names)

    return vectors.mapInArrow(place, schema)


def _tiled(placed: DataFrame, tile_bytes: int, spread_rows: int) -> DataFrame:
    """``placed`` with ``tile``: runs of cells along the first axis; a run that is too large is cut by a hash."""
    group = ["label", "width"]
    cells = placed.groupBy(*group, "cell").agg(F.count("*").alias("c"))
    along = Window.partitionBy(*group).orderBy("cell")  # at most CELLS rows a group
    whole = Window.partitionBy(*group)
    most = F.greatest(F.lit(1), F.floor(F.lit(tile_bytes) / (8 * F.col("width"))))
    wanted = F.greatest(F.ceil(F.col("size") / most), F.least(F.lit(4), F.ceil(F.col("size") / spread_rows)))
    sized = cells.withColumn("before", F.sum("c").over(along) - F.col("c")).withColumn("size", F.sum("c").over(whole)).withColumn("rows", F.ceil(F.col("size") / wanted))
    runs = sized.withColumn("run", F.floor(F.col("before") / F.col("rows")))
    within = Window.partitionBy(*group, "run")
    cut = runs.withColumn("slices", F.ceil(F.sum("c").over(within) / F.greatest("rows", F.lit(1)) / 1.5)).select(*group, "cell", "c", "run", "slices")
    total = placed.count()
    # cells of hot labels may be hot themselves
    met = meet(placed, cut, [*group, "cell"], "c", total)
    return met.withColumn("tile", F.struct("run", F.pmod(F.xxhash64("node"), F.col("slices")).alias("slice"))).drop("cell", "run", "slices", "c")


def _partners(tiled: DataFrame, threshold: float) -> DataFrame:
    """For each tile the tiles (itself too) that may hold a vector linked to one of its own."""
    keys = ["label", "width", "tile"]
    ends = [f(F.get("lead", F.lit(k))).alias(f"{name}{k}") for k in range(LEAD) for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = tiled.groupBy(*keys).agg(*ends)
    others = boxes.select("label", "width", F.col("tile").alias("other"), *[F.col(f"{e}{k}").alias(f"o_{e}{k}") for k in range(LEAD) for e in ("low", "high")])
    gap = lambda k: F.greatest(F.col(f"low{k}") - F.col(f"o_high{k}"), F.col(f"o_low{k}") - F.col(f"high{k}"), F.lit(0.0))
    apart = sum((gap(k) * gap(k) for k in range(LEAD)), F.lit(0.0))
    near = boxes.join(others, ["label", "width"]).where(apart <= 2 - 2 * threshold + CLOSE)
    return near.groupBy(*keys).agg(F.collect_list("other").alias("others"))


def _links(tiled: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """``node``, the number of its links (``links``) and a node of the same component (``joined``), for pairs of tiles."""
    keys = ["label", "width", "tile"]
    shared = tiled.sparkSession.sparkContext.broadcast(axes)
    met = tiled.drop("lead").join(_partners(tiled, threshold), keys).withColumn("other", F.explode("others"))
    sides = met.select("label", "width", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") > F.col("other")).alias("second"), "node", "copies", "embedding")

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        second, nodes, copies = (table[c].to_numpy() for c in ("second", "node", "copies"))
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["embedding"].chunks]).astype(np.float64).reshape(len(table), -1)
        alone = table["low"][0] == table["high"][0]
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        own = shared.value.get(x.shape[1])
        counts, sets = compare(x[a], None, copies[a], None, own, threshold) if alone else compare(x[a], x[b], copies[a], copies[b], own, threshold)
        names = nodes[np.concatenate([a, b])]
        some = np.flatnonzero(counts)
        return pa.table({"node": names[some], "links": counts[some], "joined": names[sets[some]]})

    return sides.groupBy("label", "width", "low", "high").applyInArrow(search, "node long, links long, joined long")


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", label_col: str = "label", embedding: str = "embedding", threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES, spread_rows: int = SPREAD_ROWS
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other vectors of the same label and width with a cosine of at
    least ``threshold``, copies one by one. ``component_id`` is the smallest id that can be
    reached over links, null ids left out (null if all are); ``kept`` says that it is the
    row's own. Vectors that are null, empty, zero or hold null or non-finite components,
    and those with a null label, have no links. Repeated rows and ids stay, and link with
    one another; an empty table gives no rows; further columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(embedding).alias("embedding"))
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))
    there = rows.where(usable).withColumn("h", F.xxhash64("embedding"))
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    with scratch(spark):
        distinct = there.groupBy("label", "h", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        distinct = materialise(distinct.withColumn("width", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
        total = distinct.agg(F.sum("copies")).first()[0] or 0
        axes = _gram(distinct)
        placed = _placed(distinct.select("node", "label", "width", "copies", "embedding"), axes)
        tiled = materialise(_tiled(placed, tile_bytes, spread_rows), "tiled-vectors")
        found = materialise(_links(tiled, axes, threshold), "vector-links")
        discard(tiled)
        sums = found.groupBy("node").agg(F.sum("links").alias("links"))
        reached = components(found.select(F.col("node").alias("a"), F.col("joined").alias("b")))
        facts = distinct.select("node", "label", "h", "embedding", "copies", "least").join(sums, "node", "left").join(reached, "node", "left")
        facts = facts.withColumn("root", F.coalesce("root", "node")).drop("node")
        least = facts.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
        named = materialise(meet(facts, least, ["root"], "members", distinct.count()), "named-vectors", keep=True)
        named = named.select("label", "h", "embedding", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    made = meet(there, named, ["label", "h", "embedding"], "copies", total).select("vec_id", "n_links", "component_id")
    return made.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
