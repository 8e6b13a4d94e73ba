"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.sources.store import discard, materialise, scratch, shared_dir

__all__ = ["SPACES", "SPACE_CLASS", "before_each", "blocks_of", "discard", "fresh", "let", "materialise", "meet", "most_used", "read", "scratch", "shared_dir", "small_batches", "span_of", "words"]

#: The characters that part words, as a regular expression class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"


def small_batches(spark: SparkSession, rows: int = 512, size: int = 1 << 25) -> None:
    """Bound the rows and bytes of an Arrow batch, so that batches of long texts stay small.

    Spark reads both settings when it plans the query, so they stay in the session;
    settings that are stricter are left as they are.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, str((1 << 31) - 1))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words (runs of anything but ASCII white space) of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+", -1))


def before_each(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs ``op`` over those before it, beginning with 0.

    An array that grows by one element is copied each time, so the values are taken in
    blocks of about the root of their number: the work grows as its power 1.5.
    """

    def run(some: Column, begin: Column) -> Column:
        grow = lambda at, x: F.struct(op(at["last"], x).alias("last"), F.concat(at["out"], F.array(at["last"])).alias("out"))
        return F.aggregate(some, F.struct(begin.alias("last"), F.array().cast("array<bigint>").alias("out")), grow)

    zero = F.lit(0).cast("bigint")

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.aggregate(b, zero, op))
        begins = let(ends, lambda e: run(e, zero)["out"])
        return let(begins, lambda starts: F.flatten(F.transform(blocks, lambda b, i: run(b, F.get(starts, i))["out"])))

    def cut(v: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / width).cast("int")), lambda b: F.slice(v, b * width + 1, width))

    blocks = lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: cut(v, width))
    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(F.array().cast("array<bigint>")))


#: Characters of a block of a long text.
BLOCK = 4_096


def blocks_of(text: Column) -> Column:
    """A text in blocks of ``BLOCK`` characters, for ``span_of``: the start of a long text isn't read again for each span."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def span_of(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` (exclusive) of the text with these blocks."""
    first, last = (start / BLOCK).cast("int"), (F.greatest(start, end - 1) / BLOCK).cast("int")
    return F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (start % BLOCK + 1).cast("int"), (end - start).cast("int"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def most_used(df: DataFrame, by: str, most: int) -> DataFrame:
    """The rows with the highest ``by`` (positive), at most ``most`` of them.

    A histogram with eight cells for each doubling gives the cut, so that tasks do
    not each send their own ``most`` rows anywhere. Rows of a cell stay together.
    """
    cell = F.floor(F.log2(F.col(by)) * 8)
    left, cut = most, None
    for at, n in df.where(F.col(by) > 0).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy(F.desc("cell")).collect():  # some hundred rows
        left -= n
        if left < 0:
            break
        cut = at
    return df.where((F.col(by) > 0) & (cell >= cut)) if cut is not None else df.limit(0)


#: A key that more than one in so many rows has is hot; fewer than so many keys can be.
HOT_SHARE = 1_024


def meet(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each combination of ``keys`` once.

    ``weight``: how many of the ``total`` rows have the key. Hot keys, fewer than
    ``HOT_SHARE`` of them, are broadcast, so their rows stay where they are; the other
    rows are shuffled, and no key has more than a ``HOT_SHARE``-th of them.
    """
    hot = F.col(weight) * HOT_SHARE > total
    values = [c for c in table.columns if c not in keys]
    name = fresh(rows.join(table.limit(0), keys), "__hot")
    few = F.broadcast(table.where(hot).select(*keys, F.struct(*values).alias(name)))
    marked = rows.join(few, keys, "left")
    here = marked.where(F.col(name).isNotNull()).select(*rows.columns, f"{name}.*")
    rest = marked.where(F.col(name).isNull()).drop(name).join(table.where(~hot), keys)
    return here.unionByName(rest.select(*here.columns))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
