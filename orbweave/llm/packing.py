"""Packing of token sequences by non-negative least squares on the length histogram.

1. Each document's ids (and an end id) are cut into windows and one shorter tail.
2. Combinations of up to three lengths that fill a window exactly are enumerated;
   non-negative least squares finds how often to repeat each so that together
   they use up the histogram; the counts are rounded within what there is.
3. What no combination takes is packed greedily, longest first, each piece where
   the last one ended; a piece that crosses the end of a sequence is cut there.

Only the histogram (at most one number per length) reaches the driver. A piece
finds its place by its number among the pieces of its length, which is its
number within the task that made it plus an offset of that task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import materialise, small_batches

WINDOW = 1024
END_ID = 0
#: Rows of the table of offsets up to which it is broadcast; beyond, it is joined by a shuffle.
MOST_BROADCAST_ROWS = 200_000
#: Entries of a worker's table of words and their ids; it is emptied when full.
MOST_CACHED = 400_000
#: Fixed value: how the byte-level tokenizers part a text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text with such a place is not the sum of its space-led words.
IRREGULAR = re.compile(r" \s| $|<\|")

_ENCODERS: dict[str, Encoder] = {}


class _Known(dict):
    """Ids (packed) of words, computed when first asked for."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_CACHED:
            self.clear()
        self[word] = ids = self.encode(self.prefix + word)
        return ids


class Encoder:
    """Ids of a ``tokenizers`` file, as little-endian unsigned 32-bit integers.

    For byte-level BPE whose ids follow the merges' order, a text is the sum of its
    words, each led by a space; words are encoded once and remembered. Other files
    and texts with unusual white space or special tokens go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        fast = self._fast(spec)
        if fast is None:
            self.first = self.later = None
        else:
            pack = lambda text: np.asarray(fast.encode_ordinary(text), dtype="<u4").tobytes()
            self.first, self.later = _Known(pack, ""), _Known(pack, " ")

    @staticmethod
    def _fast(spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec.get("normalizer") or model.get("type") != "BPE":
            return None
        import tiktoken

        # printable characters stand for themselves, the others for 256 and up in turn
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        if any(model["vocab"].get(m) != 256 + k for k, m in enumerate(merges)):
            return None
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.first is None or IRREGULAR.search(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *rest = text.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.later.__getitem__, rest))


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, doc_tokens, ids, part, rank.

    ``rank`` numbers the pieces of one length within the task ``part``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType)]
        + [T.StructField(k, T.LongType()) for k in ("start", "length", "doc_tokens")]
        + [T.StructField("ids", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("rank", T.LongType())]
    )
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(tokenizer), TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            row, start, length, total, ids, rank = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                packed = encode(text) + end
                n = len(packed) // 4
                for at in range(0, n, window):
                    size = min(window, n - at)
                    row.append(k)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    ids.append(packed[4 * at : 4 * (at + size)])
                    rank.append(seen[size])
                    seen[size] += 1
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(long(row)), long(start), long(length), long(total), pa.array(ids, pa.binary()), long([part] * len(row)), long(rank)],
                names=schema.names,
            )

    return rows.mapInArrow(cut, schema)


@dataclass(frozen=True)
class Plan:
    """Where the pieces go. Entry k serves pieces of ``length[k]`` from number ``first[k]``.

    In a combination, piece number n goes to sequence ``base + n - first`` at
    ``offset``; in the greedy part (``offset`` -1) to position ``base + (n - first)
    * length`` of one stream, which is cut into sequences.
    """

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All ways, as rows of three, to fill a window with up to three of ``lengths`` (0: none)."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = [np.array([[window, 0, 0]])] if there[window] else []
    small = lengths[lengths < window]
    pairs = small[(small * 2 <= window) & there[window - small]]
    out.append(np.stack([window - pairs, pairs, np.zeros_like(pairs)], 1))
    for a in small[small * 3 <= window]:
        b = small[(small >= a) & (small * 2 <= window - a)]
        b = b[there[window - a - b]]
        out.append(np.stack([window - a - b, b, np.full_like(b, a)], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares for the combinations' counts, by multiplicative updates."""
    size = len(histogram)
    real = combos > 0

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos[real], np.broadcast_to(x[:, None], combos.shape)[real], size)

    def gathered(v: np.ndarray) -> np.ndarray:
        return np.where(real, v[combos], 0).sum(1)

    x = np.full(len(combos), histogram[1:].sum() / max(1, len(combos)), float)
    goal = gathered(histogram.astype(float))
    for _ in range(steps):
        x *= goal / np.maximum(gathered(used(x)), 1e-12)
    return x


def make_plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for ``histogram[length]`` pieces of each length up to ``window``."""
    left = histogram.astype(np.int64).copy()
    combos = combinations(np.flatnonzero(left), window)
    repeats = np.zeros(len(combos), np.int64)
    if len(combos):
        wanted = solve_counts(combos, left)
        if left[window]:  # a whole window needs no partner
            wanted[0] = left[window]
        whole = np.floor(wanted).astype(np.int64)
        by_count, by_rest = np.argsort(-wanted, kind="stable"), np.argsort(whole - wanted, kind="stable")
        for order, most in ((by_count[whole[by_count] > 0], whole), (by_rest[(wanted - whole)[by_rest] >= 0.02], np.ones_like(whole))):
            for k in order:
                parts = combos[k][combos[k] > 0]
                need = np.bincount(parts, minlength=window + 1)
                n = min(int(most[k]), int((left[parts] // need[parts]).min()))
                if n:
                    left -= n * need
                    repeats[k] += n
    entries, next_number, sequence = [], np.zeros(window + 1, np.int64), 0
    for k in np.flatnonzero(repeats):
        offset = 0
        for size in combos[k][combos[k] > 0]:
            entries.append((size, next_number[size], sequence, offset))
            next_number[size] += repeats[k]
            offset += size
        sequence += int(repeats[k])
    position = sequence * window
    for size in np.flatnonzero(left)[::-1]:
        entries.append((size, next_number[size], position, -1))
        position += int(size * left[size])
    entries.sort()
    columns = np.array(entries, np.int64).reshape(-1, 4).T
    return Plan(*columns)


def place(pieces: DataFrame, plan: Plan, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """The pieces (with ``number`` among those of their length) at their places."""
    kept = ["doc_id", "start", "length", "doc_tokens", "number", "ids"]
    rows = pieces.select(*kept)
    long_names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType)]
        + [T.StructField(k, T.LongType()) for k in long_names]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = (p.length << 48) | p.first
        for batch in batches:
            start, length, total, number = (batch.column(k).to_numpy() for k in range(1, 5))
            at = np.searchsorted(keys, (length << 48) | number, side="right") - 1
            ahead = number - p.first[at]
            streamed = p.offset[at] < 0
            position = p.base[at] + ahead * length
            sequence = np.where(streamed, position // window, p.base[at] + ahead)
            offset = np.where(streamed, position % window, p.offset[at])
            head = np.minimum(length, window - offset)  # the part before a sequence's end
            cut = np.flatnonzero(head < length)
            row = np.concatenate([np.arange(len(length)), cut])
            skip = np.concatenate([np.zeros(len(length), np.int64), head[cut]])
            size = np.concatenate([head, length[cut] - head[cut]])
            ids = batch.column(5).to_pylist()
            own = [ids[k][4 * s : 4 * (s + n)] for k, s, n in zip(row.tolist(), skip.tolist(), size.tolist(), strict=True)]
            columns = [
                start[row] + skip,
                size,
                np.fromiter(map(zlib.crc32, own), np.int64, len(own)),
                total[row],
                sequence[row] + (skip > 0),
                np.where(skip > 0, 0, offset[row]),
            ]
            arrays = [batch.column(0).take(pa.array(row)), *[pa.array(c, pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(own, pa.binary())] if with_ids else []), names=schema.names)

    return rows.mapInArrow(put, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``with_ids`` also ``ids`` (binary, little-endian unsigned 32-bit). All
    sequences but the last are full. A null or empty text is the end id alone;
    null ids and repeated rows are packed like any others, an empty table gives no
    rows, and further columns are left out.
    """
    pieces = materialise(cut_documents(docs, tokenizer, id_col, text_col, window, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        counts.select(F.col("part").alias("__part"), F.col("length").alias("__length"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")),
        "piece-offsets",
    )
    histogram = np.zeros(window + 1, np.int64)
    for size, n in offsets.groupBy("__length").agg(F.sum("n").alias("n")).collect():  # a row per length at most
        histogram[size] = n
    side = offsets.drop("n")
    if side.count() <= MOST_BROADCAST_ROWS:
        side = F.broadcast(side)
    numbered = pieces.join(side, (pieces["part"] == side["__part"]) & (pieces["length"] == side["__length"])).withColumn(
        "number", F.col("__before") + F.col("rank")
    )
    return place(numbered, make_plan(histogram, window), window, with_ids)
