"""Tables over seeds, categories and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.scalars import bold_if, escape_latex, mean_sd
from orbweave.operators.running import quantiles


def mean_sd_table(df: DataFrame, group: str, values: list[str], population: bool = False, overall: str | None = None) -> DataFrame:
    """Mean and deviation of each value per group; a group of one has deviation 0.

    With ``overall`` a row of that name holds the means of the groups' means.
    """
    sd = F.stddev_pop if population else F.stddev_samp
    out = df.groupBy(group).agg(*[f for v in values for f in (F.avg(v).alias(f"{v}_mean"), F.coalesce(sd(v), F.lit(0.0)).alias(f"{v}_sd"))])
    if overall is None:
        return out
    total = out.agg(*[f for v in values for f in (F.avg(f"{v}_mean").alias(f"{v}_mean"), F.coalesce(sd(f"{v}_mean"), F.lit(0.0)).alias(f"{v}_sd"))])
    return out.unionByName(total.select(F.lit(overall).alias(group), *[c for c in out.columns if c != group]))


def formatted(table: DataFrame, group: str, values: list[str]) -> DataFrame:
    """A table of means and deviations as text."""
    return table.select(group, *[mean_sd(F.col(f"{v}_mean"), F.col(f"{v}_sd")).alias(v) for v in values])


def markdown(table: DataFrame, order: str) -> str:
    """A small report table as Markdown, sorted by ``order``."""
    rows = table.orderBy(order).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(table.columns), line(["---"] * len(table.columns)), *map(line, rows)])


def complete(df: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """Groups with at least ``least`` different items."""
    return df.groupBy(group).agg(F.count_distinct(item).alias("n_items")).where(F.col("n_items") >= least)


def best_and_worst(df: DataFrame, group: str, value: str) -> DataFrame:
    """The groups with the highest and lowest mean, ties by name."""
    means = df.groupBy(group).agg(F.round(F.avg(value), 6).alias("m"))
    high = F.min(F.struct((-F.col("m")).alias("m"), group)).alias("high")
    low = F.min(F.struct("m", group)).alias("low")
    return means.agg(high, low).select(
        F.col(f"high.{group}").alias("best"), (-F.col("high.m")).alias("best_mean"), F.col(f"low.{group}").alias("worst"), F.col("low.m").alias("worst_mean")
    )


def against_reference(df: DataFrame, keys: list[str], is_reference: Column, value: str) -> DataFrame:
    """Each row with the reference row's value of its keys, the difference and the drop in percent."""
    base = df.where(is_reference).groupBy(*keys).agg(F.max(value).alias("reference"))
    out = df.join(base, keys) if keys else df.crossJoin(F.broadcast(base))  # one row
    return out.withColumns({"delta": F.col(value) - F.col("reference"), "drop_percent": (F.col("reference") - F.col(value)) / F.nullif(F.col("reference"), F.lit(0.0)) * 100})


def latency(df: DataFrame, stage: str, ms: str) -> DataFrame:
    """Mean, deviation and percentiles of durations per stage."""
    moments = df.groupBy(stage).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), F.stddev_pop(ms).alias("std_ms"))
    at = quantiles(df, ms, {f"p{p}_ms": p / 100 for p in (50, 95, 99)}, (stage,)).drop("n").withColumnRenamed(stage, "__stage")
    return moments.join(at, moments[stage].eqNullSafe(at["__stage"]), "left").drop("__stage")


def compared(df: DataFrame, group: str, other: str, ours: str, overall: str = "Mean") -> DataFrame:
    """Per group the means of two columns, those groups that have both, and their difference; last the means of the groups' means.

    ``place`` orders the rows: groups by name, then ``overall``.
    """
    means = df.groupBy(group).agg(F.avg(other).alias("other"), F.avg(ours).alias("ours")).where("other IS NOT NULL AND ours IS NOT NULL")
    whole = means.agg(F.avg("other").alias("other"), F.avg("ours").alias("ours")).where("ours IS NOT NULL").select(F.lit(overall).alias(group), "other", "ours", F.lit(1).alias("last"))
    rows = means.withColumn("last", F.lit(0)).unionByName(whole)
    # a report has a row for each group
    return rows.select(F.row_number().over(Window.orderBy("last", group)).alias("place"), group, "other", "ours", (F.col("ours") - F.col("other")).alias("delta"), "last")


def latex_lines(table: DataFrame, group: str, heads: tuple[str, str, str]) -> DataFrame:
    """``compared`` as the lines of a LaTeX table: ``place`` and ``line``; shares in percent, the larger one in bold, ours on a tie."""
    percent = lambda c: F.format_string("%.2f", 100 * F.col(c))
    wins = F.col("ours") >= F.col("other")
    cells = F.concat_ws(" & ", escape_latex(F.col(group)), bold_if(~wins, percent("other")), bold_if(wins, percent("ours")), F.format_string("%+.2f", 100 * F.col("delta")))
    ends = r" \\"
    body = table.select((2 * F.col("place") + 10 + F.col("last")).alias("place"), F.concat(cells, F.lit(ends)).alias("line"))
    rule = table.where("last = 1").select((2 * F.col("place") + 10).alias("place"), F.lit(r"\midrule").alias("line"))
    name, other, ours = heads
    fixed = [(1, r"\begin{tabular}{lccc}"), (2, r"\toprule"), (3, f"{name} & {other} & {ours} & $\\Delta${ends}"), (4, r"\midrule"), (2_000_000_001, r"\bottomrule"), (2_000_000_002, r"\end{tabular}")]
    return body.unionByName(rule).unionByName(table.sparkSession.createDataFrame(fixed, "place int, line string"))


def ascii_table(metrics: dict[str, float | int], title: str = "METRIC", width: int = 68) -> str:
    """Named figures in a box: whole numbers as they are, others with four decimals."""
    line = lambda name, value: f"│ {name:<{width - 18}}{value:>15} │"
    rows = [line(name, f"{v:d}" if isinstance(v, int) else f"{v:.4f}") for name, v in metrics.items()]
    edge = lambda left, right: left + "─" * (width - 1) + right
    return "\n".join([edge("┌", "┐"), line(title, "VALUE"), edge("├", "┤"), *rows, edge("└", "┘")])
