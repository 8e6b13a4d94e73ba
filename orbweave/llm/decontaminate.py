"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Word n-grams of the benchmark items are counted in the documents that hold them.
2. Of an item's n-grams that are found at all, the rarest become its seeds. Rarity is
   relative to the item, so an item that leaked into very many documents keeps its
   seeds; n-grams that no document holds take no seed's place.
3. Where a document holds a seed, the item is aligned (Smith-Waterman, words as
   symbols) with the passage around it; the score is the share of the best
   possible one. Copies with words replaced, left out or put in keep a high score.

The benchmark is a stated query set that goes over the documents in blocks of
``BLOCK_CHARS`` characters; only one block at a time is sent to the executors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import fresh, small_batches

GRAM = 3
#: Of its n-grams that are found an item keeps this share, the rarest, as seeds; LEAST_SEEDS at least.
#: An edited copy is passed over only if all it shares with the item is among the commonest fifth.
SEED_SHARE = 0.8
LEAST_SEEDS = 8
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
LEAST_SCORE = 0.6
BLOCK_CHARS = 4_000_000


def split_words(text: bytes) -> list[str]:
    """Lower-case words (of all scripts) without the punctuation at their ends."""
    return [w for x in text.decode("utf-8", "replace").lower().split() if (w := x.strip(".,;:!?\"'()[]"))]


def grams_of(words: list[str], n: int = GRAM) -> list[str]:
    """The n-grams of consecutive words; all words at once if they are fewer."""
    return list(map(" ".join, zip(*(words[k:] for k in range(n)), strict=False))) if len(words) >= n else [" ".join(words)] * bool(words)


def begin_of(item: np.ndarray, passage: np.ndarray, end: int) -> int:
    """Where the best alignment that ends at ``end`` begins: the end of that of the reversed words."""
    return end - align(item[::-1], passage[:end][::-1])[1]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment: its score and where it ends in ``passage`` (exclusive).

    Rows run over the item. Gaps within a row are resolved by a running maximum of
    score minus gap cost, since a chain of gaps costs its length.
    """
    steps = np.arange(len(passage) + 1) * GAP
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for word in item:
        new = np.zeros(len(passage) + 1)
        np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), 0, out=new[1:])
        np.maximum(new[1:], row[1:] + GAP, out=new[1:])
        row = np.maximum.accumulate(new - steps) + steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


class Items:
    """A block of items, ready for look-up: words as numbers, n-grams with their places."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        self.places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(rows):
            words = split_words(text)
            self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32))
            for at, gram in enumerate(grams_of(words)):
                self.places.setdefault(gram, []).append((k, at))
        self.names = [name for name, _ in rows]
        self.bags = [Counter(x.tolist()) for x in self.items]
        #: Lengths of the n-grams: items of fewer words than ``GRAM`` are n-grams of their own.
        self.lengths = sorted({min(GRAM, len(x)) for x in self.items if len(x)})


def _hits(words: list[str], lengths: list[int], places: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int]]:
    for n in lengths:
        for at, gram in enumerate(grams_of(words, n) if len(words) >= n else ()):
            if gram in places:
                yield gram, at


def count_grams(docs: DataFrame, items: Items, text_col: str) -> dict[str, int]:
    """In how many documents each of the block's n-grams is found."""
    shared = docs.sparkSession.sparkContext.broadcast((items.lengths, items.places))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update({gram for gram, _ in _hits(split_words(text), *shared.value)})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).where(F.col("text").isNotNull()).mapInArrow(count, "gram string, n long")
    return {g: n for g, n in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row per n-gram of the block


def choose_seeds(items: Items, found: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """The places of each item's rarest n-grams of those ``found`` counts; ties by text."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    own: dict[int, list[tuple[int, str, int]]] = {}
    for gram, places in items.places.items():
        if gram in found:
            for k, at in places:
                own.setdefault(k, []).append((found[gram], gram, at))
    for k, grams in own.items():
        for _, gram, at in sorted(grams)[: max(LEAST_SEEDS, round(SEED_SHARE * len(grams)))]:
            seeds.setdefault(gram, []).append((k, at))
    return seeds


def align_document(words: list[str], items: Items, seeds: dict[str, list[tuple[int, int]]], least: float) -> list[tuple[int, float, int, int]]:
    """For each item that a document holds: its number, score, and the passage's words (start, end)."""
    wanted: dict[int, set[int]] = {}
    for gram, at in _hits(words, items.lengths, seeds):
        for k, place in seeds[gram]:
            # where the item would begin, in steps of its slack: few, however often a text repeats a seed
            wanted.setdefault(k, set()).add((at - place) // slack_of(items.items[k]))
    out = []
    for k, steps in wanted.items():
        item, bag = items.items[k], items.bags[k]
        slack, best = slack_of(item), (0.0, 0, 0, None)
        groups: list[list[int]] = []
        for step in sorted(steps):
            if groups and step * slack - groups[-1][1] <= slack:
                groups[-1][1] = (step + 1) * slack - 1
            else:
                groups.append([step * slack, (step + 1) * slack - 1])
        for low, high in groups:
            # long groups are taken in overlapping passages, each at least twice an item with its slack
            for start in range(low - slack, high + slack + 1, 2 * (len(item) + slack)):
                at = max(0, start)
                to = min(len(words), start + 4 * (len(item) + slack))
                numbers = [items.vocabulary.get(w, -1) for w in words[at:to]]
                common = sum((Counter(numbers) & bag).values())
                if common < least * len(item):  # the score can't exceed the words in common
                    continue
                passage = np.array(numbers, np.int32)
                score, end = align(item, passage)
                if score / len(item) > best[0]:
                    best = (score / len(item), at, end, passage)
        score, at, end, passage = best
        if passage is not None and score >= least:
            out.append((k, score, at + begin_of(item, passage, end), at + end))
    return out


def slack_of(item: np.ndarray) -> int:
    """How far an edited copy may be shifted against the item."""
    return len(item) // 2 + 2


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = LEAST_SCORE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without its text, one row for each item that a document holds:
    ``item_id``, ``score`` (0 to 1) and the passage ``start``, ``end`` (in words).

    An item of one or two words is found wherever they stand. Items without words and null texts match nothing; null ids are carried along;
    repeated items and repeated rows each give rows of their own. An empty table of
    documents or items gives no rows. Further columns of ``docs`` pass through.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (text_col, "item_id", "score", "start", "end")]
    schema = T.StructType(
        [docs.schema[c] for c in rest]
        + [T.StructField("item_id", benchmark.schema[item_col].dataType)]
        + [T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
    found = []
    for items, seeds in _blocks(docs, benchmark, text_col, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast((items, seeds))
        names = pa.array(items.names)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, hits = [], []
                for k, text in enumerate(batch.column(len(rest)).to_pylist()):
                    of_doc = align_document(split_words(text), *shared.value, least) if text else []
                    rows += [k] * len(of_doc)
                    hits += of_doc
                if rows:
                    item, score, start, end = zip(*hits, strict=True)
                    at = pa.array(rows, pa.int64())
                    columns = [names.take(pa.array(item, pa.int64())), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[: len(rest)]], *columns], names=schema.names)

        found.append(docs.select(*rest, F.col(text_col).cast("binary").alias(fresh(docs, "__text"))).mapInArrow(search, schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, block_chars: int) -> Iterator[tuple[Items, dict]]:
    """The benchmark in blocks of about ``block_chars`` characters, each with its seeds."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).where(F.length("text") > 0)
    n_blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        rows = sorted(((r[0], bytes(r[1])) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield (held := Items(rows)), choose_seeds(held, count_grams(docs, held, text_col))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = LEAST_SCORE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, by the same search.

    Rows are judged where they are read: nothing is shuffled.
    """
    kept = docs
    for items, seeds in _blocks(docs, benchmark, text_col, item_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast((items, seeds))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not t or not align_document(split_words(t), *shared.value, least) for t in texts], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
