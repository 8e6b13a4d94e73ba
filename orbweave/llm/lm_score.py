"""Language-model scores by prediction by partial matching (PPM), trained on the corpus.

The symbols are bytes. A text is read as its words with one space between them and a
line feed at its end; a symbol's context is the ``ORDER`` bytes before it, across
spaces (zero bytes stand before a text). The context trie holds, for each context, the
symbols seen after it:

* counts of the longest contexts are those of the training text; a shorter
  context counts a symbol once for each longer one in which it was seen
  (update exclusion);
* a context with total T over d symbols gives a seen symbol n / (T + d) and
  escapes with d / (T + d) (method C) to the context shorter by one byte, where
  the symbols just ruled out are excluded from n, T and d; below the empty
  context all bytes not ruled out are equally likely.

A context and its symbol (a gram) are one long, the oldest byte highest, so a shorter
context is a mask away. A gram's code length is computed once, and documents add up
those of their grams. Trie, word table and documents meet in shuffled joins that grow
with the corpus; only the ``HOT_WORDS`` and ``HOT_GRAMS`` most used words and grams are
broadcast, so that frequent keys need no shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import materialise, most_used, scratch, small_batches

ORDER = 5
#: Words, and grams, that are broadcast.
HOT_WORDS = 1 << 17
HOT_GRAMS = 1 << 19
#: Bytes of a word that is broadcast at most.
LONGEST_HOT = 64
#: Entries of a task's table of counts before it is handed on.
MOST_COUNTED = 400_000
MOST_GRAMS = 2_000_000
#: Bytes of text that are turned into grams at once.
PIECE = 1 << 21
#: The token that ends a document, as a word.
END = b""
SYMBOLS = 256


def line_of(words: list[bytes]) -> bytes:
    """The symbols of a text with these words."""
    return b" ".join(words) + b"\n"


def pieces(lines: Iterator[tuple[int, bytes]], order: int = ORDER, most: int = PIECE) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Owners, how many grams each has, and all their grams in turn, of about ``most`` bytes at a time.

    A long line is cut; each part begins with the bytes that its contexts reach back to.
    """
    owners: list[int] = []
    sizes: list[int] = []
    parts: list[bytes] = []
    held = 0
    for owner, line in lines:
        for at in range(0, len(line), most):
            part = line[at : at + most]
            owners.append(owner)
            sizes.append(len(part))
            parts += (line[at - order : at] if at else bytes(order), part)
            held += len(part)
            if held >= most:
                yield owners, sizes, _grams(parts, sizes, order)
                owners, sizes, parts, held = [], [], [], 0
    if parts:
        yield owners, sizes, _grams(parts, sizes, order)


def _grams(parts: list[bytes], sizes: list[int], order: int) -> np.ndarray:
    """The grams of the second, fourth... part; the part before each is its context."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    grams = np.zeros(len(raw) - order, np.int64)
    for k in range(order + 1):
        grams <<= 8
        grams |= raw[k : len(raw) - order + k]
    kept = np.ones(len(grams), bool)
    ends = np.cumsum(np.array(sizes) + order)[:-1] - order  # what follows reaches from one line into the next
    for k in range(order):
        kept[ends + k] = False
    return grams[kept]


class GramCounts:
    """Training counts and uses of grams, by sorted arrays that are merged from time to time."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, grams: np.ndarray, train: bool) -> None:
        found, uses = np.unique(grams, return_counts=True)
        self.held.append((found, uses if train else np.zeros_like(uses), uses))
        self.size += len(found)
        if self.size > MOST_GRAMS:
            self.merge()

    def merge(self) -> None:
        grams, n, uses = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        begins = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        self.held = [(grams[begins], np.add.reduceat(n[order], begins), np.add.reduceat(uses[order], begins))]
        self.size = len(begins)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.merge()
            ((grams, n, uses),) = self.held
            for at in range(0, len(grams), 1 << 16):
                here = slice(at, at + (1 << 16))
                columns = [pa.nulls(len(grams[here]), pa.binary()), pa.array(grams[here]), pa.array(n[here]), pa.array(uses[here])]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "gram", "c", "uses"])
        self.held, self.size = [], 0


def _word_counts(counts: dict[bool, Counter]) -> pa.RecordBatch:
    """The rows of the words counted, which are forgotten."""
    words = list(counts[True].keys() | counts[False].keys())
    c = pa.array([counts[True][w] for w in words], pa.int64())
    uses = pa.array([counts[True][w] + counts[False][w] for w in words], pa.int64())
    counts[True].clear()
    counts[False].clear()
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.nulls(len(words), pa.int64()), c, uses], names=["word", "gram", "c", "uses"])


def count(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows of either a ``word`` or a ``gram``: its count ``c`` in the rows with ``train``, and in all rows (``uses``)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        grams = GramCounts()
        for batch in batches:
            lines: dict[bool, list[bytes]] = {True: [], False: []}
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.lower().split()
                counts[train].update(words)
                counts[train][END] += 1
                lines[train].append(line_of(words))
            for train, own in lines.items():
                for _, _, found in pieces(enumerate(own), order):
                    grams.add(found, train)
            if grams.size > MOST_GRAMS // 2:
                yield from grams.flush()
            if len(counts[True]) + len(counts[False]) > MOST_COUNTED:
                yield _word_counts(counts)
        yield _word_counts(counts)
        yield from grams.flush()

    counted = docs.select("text", "train").mapInArrow(tally, "word binary, gram long, c long, uses long")
    return counted.groupBy("word", "gram").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))


def shorter(gram: Column, length: int | Column) -> Column:
    """The gram whose context has the last ``length`` bytes of that of ``gram``."""
    bits = 8 * (F.lit(length) + 1)
    return gram.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)


def context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


def build_trie(grams: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """The trie's entries (``k``, the length of their context, ``gram``, ``n``) and its nodes.

    A node (``k``, ``context``) has ``t`` and ``d``; ``t_up`` and ``d_up`` are its parent's
    total and symbols without those that the node itself has.
    """
    levels = [grams.where("c > 0").select(F.lit(order).alias("k"), "gram", F.col("c").alias("n"))]
    for k in range(order - 1, -1, -1):
        level = levels[0].groupBy(shorter(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
        levels.insert(0, materialise(level.select(F.lit(k).alias("k"), "gram", "n"), f"trie-{k}"))
    entries = levels[0]
    for level in levels[1:]:
        entries = entries.unionByName(level)
    # each gram with the count of the one that is shorter by a byte, which at most 256 grams share
    up = entries.select((F.col("k") + 1).alias("k"), F.col("gram").alias("short"), F.col("n").alias("n_up"))
    short = F.when(F.col("k") > 0, shorter(F.col("gram"), F.col("k") - 1))
    own = entries.withColumn("short", short).join(up, ["k", "short"], "left").groupBy("k", context(F.col("gram")).alias("context"))
    nodes = materialise(own.agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.coalesce(F.sum("n_up"), F.lit(0)).alias("gone")), "trie-nodes")
    parents = nodes.select((F.col("k") + 1).alias("k"), F.col("context").alias("parent"), F.col("t").alias("t_p"), F.col("d").alias("d_p"))
    parent = F.when(F.col("k") > 1, shorter(F.col("context"), F.col("k") - 2)).when(F.col("k") == 1, F.lit(0).cast("long"))
    met = nodes.withColumn("parent", parent).join(parents, ["k", "parent"], "left")
    return entries, met.select("k", "context", "t", "d", (F.col("t_p") - F.col("gone")).alias("t_up"), (F.col("d_p") - F.col("d")).alias("d_up"))


def gram_scores(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram``, ``uses`` and ``lp``, the log10 probability of its symbol in its context."""
    entries, nodes = build_trie(grams, order)
    known = grams.where("c > 0").withColumn("context", context(F.col("gram"))).join(nodes.where(F.col("k") == order), "context")
    known = known.select("gram", "uses", F.log10(F.col("c") / (F.col("t") + F.col("d"))).alias("lp"))
    # a gram that training lacks goes from its longest context to the empty one
    new = grams.where("c = 0").select("gram", "uses")

    def met(lengths: range, hint) -> DataFrame:
        step = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), shorter(F.col("gram"), k).alias("at")) for k in lengths])).alias("step")
        rows = new.select("gram", "uses", step).select("gram", "uses", "step.*").withColumn("context", context(F.col("at")))
        own = F.col("k").isin(*lengths)
        rows = rows.join(hint(nodes.where(own)), ["k", "context"], "left")
        return rows.join(hint(entries.where(own).select("k", F.col("gram").alias("at"), F.col("n").alias("n_at"))), ["k", "at"], "left")

    # contexts of up to one byte are at most 257, their entries 65,792; many grams share one, so these are broadcast
    steps = met(range(min(order, 1) + 1), F.broadcast)
    if order > 1:
        steps = steps.unionByName(met(range(2, order + 1), lambda df: df))
    down = F.sort_array(F.collect_list(F.struct(-F.col("k"), "n_at", "t", "d", "t_up", "d_up")))

    def descend(at: Column, e: Column) -> Column:
        t, d = F.coalesce(at["t"], e["t"]), F.coalesce(at["d"], e["d"])
        part = F.when(e["n_at"].isNotNull(), e["n_at"]).when(d > 0, d)
        lp = at["lp"] + F.when(at["done"], F.lit(0.0)).otherwise(F.coalesce(F.log10(part / (t + d)), F.lit(0.0)))
        return F.struct(lp.alias("lp"), e["t_up"].alias("t"), e["d_up"].alias("d"), e["d"].alias("symbols"), (at["done"] | e["n_at"].isNotNull()).alias("done"))

    none = F.lit(None).cast("long")
    begin = F.struct(F.lit(0.0).alias("lp"), none.alias("t"), none.alias("d"), none.alias("symbols"), F.lit(False).alias("done"))
    even = lambda at: F.log10(F.greatest(F.lit(1), F.lit(SYMBOLS) - F.coalesce(at["symbols"], F.lit(0))).cast("double"))
    lp = F.aggregate("down", begin, descend, lambda at: at["lp"] - F.when(at["done"], F.lit(0.0)).otherwise(even(at)))
    found = steps.groupBy("gram").agg(F.max("uses").alias("uses"), down.alias("down")).select("gram", "uses", lp.alias("lp"))
    return known.unionByName(found)


def pair_counts(owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a gram and its owner, and how often each occurs; ``owner`` rises."""
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    begins = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
    return owner[begins], grams[begins], np.diff(np.r_[begins, len(grams)])


class HotGrams:
    """Look-up of the broadcast grams' code lengths: a table of slots, and a search for those that share a slot."""

    def __init__(self, grams: np.ndarray, lp: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.lp = grams[order], lp[order]
        self.bits = max(1, int(4 * len(grams)).bit_length())
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        at = self.slot(self.grams)
        self.slots[at] = self.grams
        there = self.slots[at] == self.grams
        self.values[at[there]] = self.lp[there]
        self.grams, self.lp = self.grams[~there], self.lp[~there]  # the few that lost their slot to another

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each gram's code length (0 if it isn't hot), and the places of those that aren't."""
        at = self.slot(grams)
        own = self.slots[at] == grams
        out = np.where(own, self.values[at], 0.0)
        left = np.flatnonzero(~own)
        if not len(self.grams):
            return out, left
        near = np.minimum(np.searchsorted(self.grams, grams[left]), len(self.grams) - 1)
        hit = self.grams[near] == grams[left]
        out[left[hit]] = self.lp[near[hit]]
        return out, left[~hit]


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", order: int = ORDER, hot_words: int = HOT_WORDS, hot_grams: int = HOT_GRAMS
) -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is that of smoothed single words, ``score`` the model's log10
    probability of the text; both learn from the rows with ``train`` (null: false).
    A null or empty text is the end token alone. Null ids and repeated rows each
    keep their row; a word or a text may be of any length; an empty table gives no
    rows; further columns are left out. ``order`` is 6 at most.
    """
    if not 0 <= order <= 6:
        raise ValueError(f"an order of 0 to 6 is needed, not {order}")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train")
    )
    counts = materialise(count(rows, order), "counts")
    words, grams = counts.where("word is not null").select("word", "c", "uses"), counts.where("gram is not null").select("gram", "c", "uses")
    train_tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    with scratch(spark):
        scores = materialise(gram_scores(grams, order), "gram-scores", keep=True)
    whole = train_tokens + 0.5 * (distinct + 1)
    # at most ``hot_words`` words of LONGEST_HOT bytes and ``hot_grams`` numbers; longer words go to the join
    top_words, top_grams = most_used(words.where(F.length("word") <= LONGEST_HOT), "uses", hot_words).toArrow(), most_used(scores, "uses", hot_grams).toArrow()
    shared = spark.sparkContext.broadcast((top_words["word"].to_pylist(), top_words["c"].to_pylist(), top_grams["gram"].to_numpy(), top_grams["lp"].to_numpy()))
    schema = T.StructType(
        [T.StructField("key", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("train", T.BooleanType())]
        + [T.StructField("word", T.BinaryType()), T.StructField("gram", T.LongType())]
        + [T.StructField(k, t) for k, t in (("n", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()))]
    )

    def batch_of(size: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"doc_id": columns["doc_id"].type if "doc_id" in columns else pa.null(), "train": pa.bool_(), "word": pa.binary(), "base": pa.float64(), "score": pa.float64()}
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(size, kinds.get(k, pa.int64()))) for k in schema.names], names=schema.names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, hot, lp = shared.value
        known = {w: (c, math.log10((c + 0.5) / whole)) for w, c in zip(names, c, strict=True)}
        table = HotGrams(hot, lp)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            size = len(batch)
            lines: list[bytes] = []
            rare: list[tuple[int, bytes, int]] = []
            sums: list[tuple[int, int, float]] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = text.lower().split()
                lines.append(line_of(words))
                words.append(END)
                n_known, base = 0, 0.0
                for w, n in Counter(words).items():
                    hit = known.get(w)
                    if hit is None:
                        rare.append((key + k, w, n))
                    else:
                        n_known += n if hit[0] else 0
                        base += n * hit[1]
                sums.append((len(words), n_known, base))
            total = np.zeros(size)
            for owners, sizes, found in pieces(enumerate(lines), order):
                lengths, left = table.find(found)
                begins = np.cumsum([0, *sizes[:-1]])
                np.add.at(total, owners, np.add.reduceat(lengths, begins))
                if len(left):
                    owner = np.array(owners)[np.searchsorted(begins, left, "right") - 1]
                    of, gram, times = pair_counts(owner, found[left])
                    yield batch_of(len(times), key=pa.array(key + of), doc_id=pa.nulls(len(times), batch.column(0).type), gram=pa.array(gram), n=pa.array(times.astype(np.int64)))
            if rare:
                of, w, n = zip(*rare, strict=True)
                yield batch_of(len(of), key=pa.array(of, pa.int64()), doc_id=pa.nulls(len(of), batch.column(0).type), word=pa.array(w, pa.binary()), n=pa.array(n, pa.int64()))
            n, n_known, base = zip(*sums, strict=True) if sums else ((), (), ())
            own = {"n": pa.array(n, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base, pa.float64()), "score": pa.array(total)}
            yield batch_of(size, key=pa.array(np.arange(key, key + size)), doc_id=batch.column(0), train=batch.column(2), **own)
            key += size

    parts = materialise(rows.mapInArrow(score, schema), "score-parts")
    base = F.log10((F.col("c") + 0.5) / F.lit(whole))
    of_words = parts.where("word is not null").select("key", "word", "n").join(words, "word")
    of_words = of_words.select("key", F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)).alias("n_known"), (F.col("n") * base).alias("base"), F.lit(0.0).alias("score"))
    of_grams = parts.where("gram is not null").select("key", "gram", "n").join(scores.select("gram", "lp"), "gram")
    of_grams = of_grams.select("key", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), (F.col("n") * F.col("lp")).alias("score"))
    sums = {k: f"more_{k}" for k in ("n_known", "base", "score")}
    rest = of_words.unionByName(of_grams).groupBy("key").agg(*[F.sum(k).alias(more) for k, more in sums.items()])
    out = parts.where("word is null and gram is null").join(rest, "key", "left")
    whole_sums = {k: F.col(k) + F.coalesce(F.col(more), F.lit(0)) for k, more in sums.items()}
    return out.select(
        "doc_id",
        "train",
        F.col("n").alias("n_tokens"),
        whole_sums["n_known"].alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        whole_sums["base"].alias("base_score"),
        whole_sums["score"].alias("score"),
    )
