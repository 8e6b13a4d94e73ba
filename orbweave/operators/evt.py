"""Extreme-value thresholds: peaks over threshold with a generalised Pareto tail."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.running import quantiles, running_sums
from orbweave.sources.store import materialise

#: Times that a grid of theta is refined, and rows of a bucket that one task resamples.
ROUNDS = 4
BUCKET_ROWS = 4_096
LEAST_SPREAD = 1e-12


def tail_start(df: DataFrame, score: str, fraction: float, groups: tuple[str, ...] = (), rule: str = "index") -> DataFrame:
    """Per group: ``n`` and the score ``u`` where its tail begins.

    ``index``: the value at place int(n * (1 - fraction)) of the sorted scores;
    ``index_min10``: the same, but leaving ten rows at least; ``percentile``: the
    interpolated quantile. The index rules rank distinct values by running counts,
    so no group is gathered.
    """
    rows = df.where(F.col(score).isNotNull())
    if rule == "percentile":
        return quantiles(rows, score, {"u": 1 - fraction}, groups)
    if rule not in ("index", "index_min10"):
        raise ValueError(f"unknown rule: {rule}")
    by_value = rows.groupBy(*groups, F.col(score).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ranked = running_sums(by_value, "v", {"before": "c"}, groups)
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    joined = ranked.join(sizes, list(groups)) if groups else ranked.withColumn("n", F.lit(rows.count()).cast("long"))
    place = F.floor(F.col("n") * (1 - fraction)).cast("long")
    if rule == "index_min10":
        place = F.greatest(F.lit(0).cast("long"), F.least(place, F.col("n") - 10))
    return joined.where((F.col("before") <= place) & (place < F.col("before") + F.col("c"))).select(*groups, "n", F.col("v").alias("u"))


def _first_grid(top: float) -> np.ndarray:
    """Values of theta = shape / scale, for excesses of mean 1 of which the largest is ``top``."""
    small = np.geomspace(1e-6, 1, 60)
    return np.unique(np.concatenate([-1 / top * (1 - 1e-9) * small, small * 50.0]))


def _likelihood(theta: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Mean log-likelihood at theta with its best shape, the mean of log(1 + theta * x)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        value = -np.log(shape / theta) - shape - 1
    return np.where((shape >= -1) & np.isfinite(value), value, -np.inf)


def _finer(grid: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """A grid between the neighbours of the best point."""
    k = int(_likelihood(grid, shape).argmax())
    grid = np.linspace(grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)], 81)
    return grid[grid != 0]


def _best(grid: np.ndarray, shape: np.ndarray, scale: float) -> tuple[float, float]:
    value = _likelihood(grid, shape)
    k = int(value.argmax())
    if -1.0 >= value[k]:  # the exponential law, the limit at shape 0, is at least as likely
        return 0.0, float(scale)
    return float(shape[k]), float(shape[k] / grid[k] * scale)


def fit_gpd(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float] | None:
    """Shape and scale by maximum likelihood at location 0; None for a degenerate tail.

    The likelihood is profiled over theta = shape / scale; a grid over theta is refined
    ``ROUNDS`` times.
    """
    w = np.ones(len(x)) if weight is None else weight
    if not len(x) or x.max() <= LEAST_SPREAD or np.ptp(x) <= LEAST_SPREAD:
        return None
    scale = np.average(x, weights=w)
    y, total = x / scale, w.sum()
    grid = _first_grid(y.max())
    for _ in range(ROUNDS):
        grid = _finer(grid, np.log1p(np.outer(grid, y)) @ w / total)
    return _best(grid, np.log1p(np.outer(grid, y)) @ w / total, scale)


def profile_sums(excess: DataFrame, grids: dict[tuple, tuple[float, np.ndarray]], groups: tuple[str, ...]) -> dict[tuple, np.ndarray]:
    """For each group and theta of its grid the sum of w * log(1 + theta * x / scale), from rows of ``x`` and ``w``.

    ``grids`` has a scale and a grid for each group that is fitted. A task adds up its own rows;
    only a number for each group and theta leaves it.
    """
    names = list(grids)
    place = {key: k for k, key in enumerate(names)}
    shared = excess.sparkSession.sparkContext.broadcast((place, [grids[n] for n in names]))
    n_keys = len(groups)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, of = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:n_keys]), strict=True)) if n_keys else [()] * len(batch)
            own = np.array([place.get(k, -1) for k in keys], np.int64)
            x, w = batch.column(n_keys).to_numpy(), batch.column(n_keys + 1).to_numpy()
            for k in np.unique(own[own >= 0]).tolist():
                scale, grid = of[k]
                mine = np.flatnonzero(own == k)
                for at in range(0, len(mine), 4_096):
                    some = mine[at : at + 4_096]
                    sums[k] = sums.get(k, 0.0) + np.log1p(np.outer(grid, x[some] / scale)) @ w[some]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["k", "sums"])

    parts = excess.select(*groups, F.col("x").cast("double"), F.col("w").cast("double")).mapInArrow(add, "k int, sums array<double>")
    out = {n: np.zeros(len(g)) for n, (_, g) in grids.items()}
    for r in parts.select("k", F.posexplode("sums").alias("at", "s")).groupBy("k", "at").agg(F.sum("s").alias("s")).collect():  # a grid a group
        out[names[r.k]][r.at] = r.s
    return out


def threshold(u: Column, shape: Column, scale: Column, alpha: float, tail: float, near_zero: float = 1e-5, conditional: bool = True) -> Column:
    """The score exceeded with probability ``alpha``; 1.05 u where there is no fit.

    ``conditional`` divides alpha by the tail's share of the scores.
    """
    p = alpha / tail if conditional else alpha
    curved = u + scale / F.when(shape == 0, F.lit(1.0)).otherwise(shape) * (F.pow(F.lit(p), -shape) - 1)
    flat = u - scale * math.log(p)
    return F.when(shape.isNull() | scale.isNull(), 1.05 * u).when(F.abs(shape) < near_zero, flat).otherwise(curved)


def tail_excesses(df: DataFrame, score: str, groups: tuple[str, ...], fraction: float = 0.1, rule: str = "index") -> tuple[DataFrame, DataFrame]:
    """The distinct positive excesses over the tail's start (``x``) with their number (``w``), and per group
    n, u, n_tail, the largest excess ``top``, the least ``low`` and the ``mean`` of the whole tail.

    By the index rules the tail has n - place rows, so of several rows at u as many as fit
    belong to it, with an excess of 0; by ``percentile`` it has the rows above u.
    """
    starts = tail_start(df, score, fraction, groups, rule)
    keys = list(groups)
    if not groups:
        starts, df = starts.withColumn("__all", F.lit(1)), df.withColumn("__all", F.lit(1))
        keys = ["__all"]
    above = df.where(F.col(score).isNotNull()).join(starts.select(*keys, "u"), keys).where(F.col(score) > F.col("u"))
    excess = above.groupBy(*keys, (F.col(score).cast("double") - F.col("u")).alias("x")).agg(F.count("*").alias("w"))
    excess = materialise(excess, "tail")
    spans = excess.groupBy(*keys).agg(F.max("x").alias("top"), F.min("x").alias("low"), F.sum("w").alias("above"), F.sum(F.col("x") * F.col("w")).alias("total"))
    place = F.floor(F.col("n") * (1 - fraction)).cast("long")
    if rule == "index_min10":
        place = F.greatest(F.lit(0).cast("long"), F.least(place, F.col("n") - 10))
    n_tail = F.coalesce("above", F.lit(0)) if rule == "percentile" else F.col("n") - place
    facts = starts.join(spans, keys, "left").withColumn("n_tail", n_tail.cast("long"))
    low = F.when(F.col("n_tail") > F.coalesce("above", F.lit(0)), 0.0).otherwise(F.col("low"))
    facts = facts.select(*groups, "n", "u", "n_tail", "top", low.alias("low"), (F.col("total") / F.nullif("n_tail", F.lit(0))).alias("mean"))
    return excess.select(*groups, "x", "w"), facts


def gpd_thresholds(df: DataFrame, score: str, groups: tuple[str, ...], fraction: float = 0.1, alpha: float = 0.01, rule: str = "index") -> DataFrame:
    """Per group: n, u, n_tail, shape, scale and the threshold ``tau``.

    The fit is ``fit_gpd`` of the whole tail at every size: in each of its rounds the tasks add
    up the likelihood of their own rows over the groups' grids of theta, and the driver, which
    holds one grid a group, refines them. Shape and scale are null for a degenerate tail.
    """
    excess, facts = tail_excesses(df, score, groups, fraction, rule)
    spark = df.sparkSession
    rows = facts.collect()  # one row a group
    known = {tuple(r[g] for g in groups): r for r in rows if r.top is not None and r.top > LEAST_SPREAD and r.top - r.low > LEAST_SPREAD}
    grids = {key: (r["mean"], _first_grid(r.top / r["mean"])) for key, r in known.items()}
    shapes: dict[tuple, np.ndarray] = {}
    for k in range(ROUNDS + 1 if grids else 0):
        sums = profile_sums(excess, grids, groups)
        shapes = {key: sums[key] / known[key].n_tail for key in grids}
        if k < ROUNDS:
            grids = {key: (scale, _finer(grid, shapes[key])) for key, (scale, grid) in grids.items()}
    fits = {key: _best(grid, shapes[key], scale) for key, (scale, grid) in grids.items()}
    kinds = "".join(f"{g} {df.schema[g].dataType.simpleString()}, " for g in groups)
    made = [(*(r[g] for g in groups), r.n, r.u, r.n_tail, *fits.get(tuple(r[g] for g in groups), (None, None))) for r in rows]
    out = spark.createDataFrame(made, f"{kinds}n long, u double, n_tail long, shape double, scale double")
    return out.withColumn("tau", threshold(F.col("u"), F.col("shape"), F.col("scale"), alpha, fraction))


def bootstrap_rate(rates: DataFrame, groups: tuple[str, ...], hits: str, n: str, replicates: int = 1_000, seed: int = 42) -> DataFrame:
    """Percentile interval (2.5 and 97.5) of a rate, by resampling.

    A resample of n rows of which a share p are hits has Binomial(n, p) hits, so only
    counts per group are needed, however many rows there are.
    """

    def draw(batches):
        for rows in batches:
            out = rows[[*groups]].copy()
            low, high = [], []
            for k in range(len(rows)):
                size, share = int(rows[n].iloc[k]), rows[hits].iloc[k] / max(1, rows[n].iloc[k])
                own = "|".join(str(rows[g].iloc[k]) for g in groups)
                rng = np.random.default_rng([seed, *own.encode()])
                drawn = rng.binomial(size, share, replicates) / max(1, size)
                low.append(float(np.percentile(drawn, 2.5)))
                high.append(float(np.percentile(drawn, 97.5)))
            yield out.assign(rate=rows[hits] / rows[n], ci_low=low, ci_high=high)

    kinds = ", ".join(f"{g} {rates.schema[g].dataType.simpleString()}" for g in groups)
    return rates.mapInPandas(draw, f"{kinds}, rate double, ci_low double, ci_high double")


def _derived(*parts: object) -> int:
    """A seed of 32 bits from what names a draw."""
    return zlib.crc32(repr(parts).encode())


def bootstrap_rows(df: DataFrame, groups: tuple[str, ...], value: str, id_col: str, replicates: int = 1_000, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per group: n, the ``mean`` of ``value``, and of the means of ``replicates`` resamples of its rows the
    percentiles 2.5 and 97.5 (``ci_low``, ``ci_high``), 0.5 and 99.5 (``ci_low_99``, ``ci_high_99``), mean and deviation.

    Each resample draws n of the group's n rows with replacement. Rows fall into buckets by the leading bits
    of a hash of their id; how many of the draws go to the left half of the buckets, and so on down, is
    binomial by the halves' sizes, drawn from seeds that all buckets below share. So the buckets' numbers are
    those of one multinomial draw though no task sees more than one bucket. A group of one bucket, sorted by
    id, repeats ``RandomState(seed).choice(n, n)`` for each replicate in turn. Null values take no part.
    """
    keys = [f"__g{k}" for k in range(len(groups))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"))
    if not groups:
        keys, rows = ["__g0"], rows.withColumn("__g0", F.lit(1))
    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, largest / bucket_rows))))
    bucket = F.shiftrightunsigned(F.xxhash64("id"), 64 - levels) if levels else F.lit(0).cast("long")
    placed = rows.withColumn("bucket", bucket.cast("long"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sizes = materialise(placed.groupBy(*keys, "bucket").agg(F.count("*").alias("m")), "bootstrap-buckets")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    nodes = sizes.select(*keys, "m", "bucket", level).withColumn("node", F.floor(F.col("bucket") / F.pow(F.lit(2.0), F.lit(levels) - F.col("level"))).cast("long"))
    totals = nodes.groupBy(*keys, "level", "node").agg(F.sum("m").alias("size"))
    # what a bucket needs of its way down: at each level the size of the node and of its left half
    even = totals.where("level > 0 AND node % 2 = 0").select(*[F.col(k).alias(f"l{k}") for k in keys], (F.col("level") - 1).alias("l_level"), F.floor(F.col("node") / 2).cast("long").alias("l_node"), F.col("size").alias("left"))
    on_keys = [same(k, f"l{k}") for k in keys]
    halves = totals.join(even, [*on_keys, same("level", "l_level"), same("node", "l_node")], "left").select(*keys, "level", "node", "size", F.coalesce("left", F.lit(0)).alias("left"))
    named = halves.select(*[F.col(k).alias(f"h{k}") for k in keys], F.col("level").alias("h_level"), F.col("node").alias("h_node"), "size", "left")
    way = nodes.join(named, [*[same(k, f"h{k}") for k in keys], same("level", "h_level"), same("node", "h_node")])
    ways = way.groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list(F.struct("level", "node", "size", "left"))).alias("way"))

    def draw(table: pa.Table, of: pa.Table) -> pa.Table:
        key = [of[k][0].as_py() for k in keys]
        own, way = of["bucket"][0].as_py(), of["way"][0].as_py()
        draws = np.full(replicates, way[0]["size"], np.int64)
        for step, below in zip(way, way[1:], strict=False):
            rng = np.random.default_rng([seed, _derived(key, step["level"], step["node"])])
            to_left = rng.binomial(draws, step["left"] / step["size"])
            draws = draws - to_left if below["node"] % 2 else to_left
        values = table.sort_by("id")["v"].to_numpy()
        source = np.random.RandomState(seed if not levels else _derived(seed, key, own))
        sums = [float(values[source.choice(len(values), size=n, replace=True)].sum()) if n else 0.0 for n in draws.tolist()]
        return pa.table({**{k: of[k][:1] for k in keys}, "sums": pa.array([sums], pa.list_(pa.float64()))})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    drawn = placed.groupBy(*keys, "bucket").cogroup(ways.groupBy(*keys, "bucket")).applyInArrow(draw, f"{kinds}, sums array<double>")
    whole = drawn.select(*keys, F.posexplode("sums").alias("replicate", "s")).groupBy(*keys, "replicate").agg(F.sum("s").alias("s"))
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    facts = facts.select(*[F.col(k).alias(f"f{k}") for k in keys], "n", "mean")
    means = whole.join(facts, [same(k, f"f{k}") for k in keys]).withColumn("r", F.col("s") / F.col("n"))
    quantile = lambda q, name: F.percentile("r", q).alias(name)  # noqa: E731  # ``replicates`` numbers a group
    out = means.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), quantile(0.025, "ci_low"), quantile(0.975, "ci_high"), quantile(0.005, "ci_low_99"), quantile(0.995, "ci_high_99"),
        F.avg("r").alias("replicate_mean"), F.stddev_pop("r").alias("replicate_sd"),
    )
    return out.select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=False)], *[c for c in out.columns if c not in keys])
