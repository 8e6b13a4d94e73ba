"""Near-duplicates by SimHash with anchor-point covering.

Fingerprints (64 bits) that differ in at most three bits differ in at most one bit
of one of their 32-bit halves. On 31 bits of each half the Hamming code is a
perfect covering code of radius 1: every value has exactly one codeword, its
anchor, within one bit. A fingerprint is replicated to all anchors within
radius + threshold = 2 bits of its half; two halves that differ in at most one bit
meet at the anchor of either. Fingerprints are compared per anchor, on all 64 bits.

Equal fingerprints are first reduced to one, so large groups of copies cost
nothing. Within an anchor only links that join something new are kept, a forest
rather than all pairs. Groups above ``MOST_AT_ANCHOR`` are compared in pairs of
chunks by separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import discard, materialise, scratch, small_batches

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Fingerprints at one anchor that one task compares; more are cut into chunks of half that.
MOST_AT_ANCHOR = 20_000
#: Keys of chosen rows, of 8 bytes, that one task holds, about.
MOST_KEYS = 1_000_000


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounds the memory that the bits take
        counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def add_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", row_key: str | None = None) -> DataFrame:
    """``docs`` with the long ``out``; a null or empty text gives 0.

    With ``row_key`` also a long of that name that no other row has. It depends on
    how the rows are read, so the result is to be written before it is used twice.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (out, row_key)]
    added = [T.StructField(out, T.LongType())] + ([T.StructField(row_key, T.LongType())] if row_key else [])
    schema = T.StructType([docs.schema[c] for c in rest] + added)
    at = rest.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            prints = [fingerprint(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = [*batch.columns, pa.array(prints, pa.int64())]
            if row_key:
                columns.append(pa.array(range(row, row + len(prints)), pa.int64()))
                row += len(prints)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*rest).mapInArrow(add, schema)


def _syndromes() -> np.ndarray:
    """Syndrome of every 31-bit value, by its four bytes: XOR of the places (1 to 31) of its bits."""
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            place = 8 * byte + bit + 1
            if place <= 31:
                table[byte, (np.arange(256) >> bit) & 1 == 1] ^= np.uint32(place)
    return table


def _near_pairs() -> np.ndarray:
    """For each syndrome, masks of one or two bits (0: none) that lead to a codeword.

    A codeword (syndrome 0) is its own only anchor within two bits; any other
    value has one at one bit and 15 at two bits.
    """
    masks = np.zeros((32, 16), np.uint32)
    bit = lambda place: np.uint32(1 << (place - 1))
    for s in range(1, 32):
        pairs = [(a, a ^ s) for a in range(1, 32) if a < a ^ s <= 31]
        masks[s] = [bit(s), *[bit(a) | bit(b) for a, b in pairs]]
    return masks


SYNDROMES, NEAR = _syndromes(), _near_pairs()


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors (31-bit codewords) within two bits of 32-bit halves."""
    v = halves.astype(np.uint32) & np.uint32(0x7FFFFFFF)
    syndrome = SYNDROMES[0, v & 255] ^ SYNDROMES[1, (v >> 8) & 255] ^ SYNDROMES[2, (v >> 16) & 255] ^ SYNDROMES[3, v >> 24]
    own = np.flatnonzero(syndrome == 0)
    other = np.flatnonzero(syndrome)
    near = v[other, None] ^ NEAR[syndrome[other]]
    return np.concatenate([own, np.repeat(other, 16)]), np.concatenate([v[own], near.ravel()])


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (pairs of row numbers) that join all rows within the threshold, without circles."""
    left = np.arange(1, len(prints))
    links, front = [], [0]
    while len(left):
        at = front.pop() if front else None
        if at is None:
            at, left = int(left[0]), left[1:]
        near = np.bitwise_count(prints[left] ^ prints[at]) <= THRESHOLD
        found = left[near].tolist()
        links += [(at, k) for k in found]
        front += found
        left = left[~near]
    return links


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and fingerprints of sorted batches, cut so that each key is in one yield."""
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys):
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield keys[:end], prints[:end]
                keys, prints = keys[end:], prints[end:]
    if len(keys):
        yield keys, prints


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, prints in _runs(batches):
        a: list[int] = []
        b: list[int] = []
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= THRESHOLD]
        signed = prints.view(np.int64)
        a += signed[two].tolist()
        b += signed[two + 1].tolist()
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for x, y in forest(prints[at : at + n]):
                a.append(int(signed[at + x]))
                b.append(int(signed[at + y]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def link_fingerprints(prints: DataFrame, most_at_anchor: int = MOST_AT_ANCHOR) -> DataFrame:
    """Links ``a``, ``b`` among distinct fingerprints (column ``fp``) that join all
    that differ in at most three bits; some may be listed more than once."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for half in (0, 1):
                row, anchor = anchors((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
                key = anchor.astype(np.int64) * 2 + half
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], names=["anchor", "fp"])

    placed = prints.select("fp").mapInArrow(spread, "anchor long, fp long")
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = materialise(sizes, "anchor-sizes")
    hot = sizes.where(F.col("n") > most_at_anchor)
    shared = placed.join(sizes.where(F.col("n") <= most_at_anchor), "anchor", "left_semi")
    found = _compare(shared.select(F.col("anchor").alias("key"), "fp"))
    if hot.isEmpty():
        return found
    # a large group: its chunks meet in pairs, each pair in a task of its own
    chunks = F.ceil(F.col("n") / F.lit(most_at_anchor // 2)).cast("int")
    rows = placed.join(hot, "anchor").withColumn("k", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    paired = rows.select("anchor", "fp", "c", other.alias("o")).select(
        F.xxhash64("anchor", F.least("c", "o"), F.greatest("c", "o")).alias("key"), "fp"
    )
    return found.unionByName(_compare(paired.distinct()))


def _compare(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for all nodes of ``links`` (a, b).

    Large-star and small-star steps in turn, until nothing changes; each round is
    written to the shared folder, so the lineage stays short, and deleted after the next.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (long) and ``component_id``.

    ``component_id`` is the smallest id of the documents that can be reached over
    links of at most three differing bits, null ids left out (null if all are).
    Texts without words, null ones too, have fingerprint 0 and are linked like any
    other. Repeated rows stay; an empty table gives no rows; further columns are
    left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialise(add_fingerprints(rows, "text", "fp").drop("text"), "fingerprints")
    with scratch(docs.sparkSession):
        prints = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
        reached = components(link_fingerprints(prints)).withColumnRenamed("node", "fp")
        rooted = prints.join(reached, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        names = materialise(rooted.join(named, "root").select("fp", "component_id"), "components", keep=True)
    return marked.join(names, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id (a null id
    last), of rows that share it that with the smallest hash of the text, of equal
    rows any one. All columns are kept.

    The rows meet the chosen keys in one hash join by shuffle, at every size: the keys
    grow with the input, so they are not broadcast, and texts need no sorting. There are as
    many partitions as keep the keys of each below ``MOST_KEYS``, which a task holds.
    """
    marked = materialise(add_fingerprints(docs, text_col, "__fp", row_key="__row"), "fingerprints")
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col("__row").alias("row"))
    with scratch(docs.sparkSession):
        prints = materialise(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(first).alias("least")), "distinct-fingerprints")
        reached = components(link_fingerprints(prints)).withColumnRenamed("node", "fp")
        chosen = prints.join(reached, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
        chosen = materialise(chosen.select(F.col("least.row").alias("__row")), "chosen", keep=True)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chosen.count() // MOST_KEYS))
    kept = marked.repartition(parts, "__row").join(chosen.repartition(parts, "__row").hint("shuffle_hash"), "__row", "left_semi")
    return kept.select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
