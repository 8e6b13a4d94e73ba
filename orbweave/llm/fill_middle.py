"""Fill-in-middle formatting of texts held as ropes.

A text is cut into units (a word with the white space before it, or white space at the
end). Its rope is a balanced tree whose leaves hold runs of whole units; each node knows
the units and code points below it. Splitting at a rank goes down one path, and joining
makes one node, so the pieces are rearranged without copying the text; the output is
written once. The inverse cuts the rope of the output at its sentinels.

Rows are formatted where they are read: nothing is shuffled or gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import small_batches

SEED = 42
#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are rearranged, and of those percent in the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SENTINEL = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
#: Code points of a leaf; a unit that is longer has a leaf of its own.
LEAF = 2_048


class Leaf(NamedTuple):
    """A run of whole units (``ends``: where each ends), or text of no units such as a sentinel."""

    text: str
    ends: tuple[int, ...]

    @property
    def units(self) -> int:
        return len(self.ends)

    @property
    def chars(self) -> int:
        return len(self.text)


class Node(NamedTuple):
    left: Rope
    right: Rope
    units: int
    chars: int


Rope = Leaf | Node
EMPTY = Leaf("", ())


def joined(left: Rope, right: Rope) -> Rope:
    """The concatenation of two ropes: one new node."""
    if not left.chars:
        return right
    return Node(left, right, left.units + right.units, left.chars + right.chars) if right.chars else left


def balanced(leaves: list[Rope]) -> Rope:
    """A tree of logarithmic height over the leaves."""
    while len(leaves) > 1:
        leaves = [joined(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def rope(text: str, leaf: int = LEAF) -> Rope:
    """The rope of a text, with leaves of at most about ``leaf`` code points."""
    leaves, begin, ends = [], 0, []
    for found in UNIT.finditer(text):
        if ends and found.end() - begin > leaf:
            leaves.append(Leaf(text[begin : begin + ends[-1]], tuple(ends)))
            begin, ends = begin + ends[-1], []
        ends.append(found.end() - begin)
    if ends:
        leaves.append(Leaf(text[begin:], tuple(ends)))
    return balanced(leaves)


def split_units(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units and the rest."""
    above = []
    while isinstance(tree, Node):
        if rank <= tree.left.units:
            above.append((tree.right, False))
            tree = tree.left
        else:
            above.append((tree.left, True))
            rank -= tree.left.units
            tree = tree.right
    cut = tree.ends[rank - 1] if rank else 0
    left, right = Leaf(tree.text[:cut], tree.ends[:rank]), Leaf(tree.text[cut:], tuple(e - cut for e in tree.ends[rank:]))
    return _rejoined(above, left, right)


def split_chars(tree: Rope, at: int) -> tuple[Rope, Rope]:
    """The first ``at`` code points and the rest; units that are cut are not counted."""
    above = []
    while isinstance(tree, Node):
        if at <= tree.left.chars:
            above.append((tree.right, False))
            tree = tree.left
        else:
            above.append((tree.left, True))
            at -= tree.left.chars
            tree = tree.right
    return _rejoined(above, Leaf(tree.text[:at], tuple(e for e in tree.ends if e <= at)), Leaf(tree.text[at:], tuple(e - at for e in tree.ends if e > at)))


def _rejoined(above: list[tuple[Rope, bool]], left: Rope, right: Rope) -> tuple[Rope, Rope]:
    """Both sides of a cut with the subtrees that hung beside the path to it."""
    for side, before in reversed(above):
        left, right = (joined(side, left), right) if before else (left, joined(right, side))
    return left, right


def flat(tree: Rope) -> str:
    """The text of a rope, from its leaves in order."""
    parts, rest = [], [tree]
    while rest:
        at = rest.pop()
        if isinstance(at, Node):
            rest += [at.right, at.left]
        else:
            parts.append(at.text)
    return "".join(parts)


class Draw(NamedTuple):
    """The four numbers that a document's id gives."""

    first: int
    second: int
    form: int
    order: int


def draw(doc_id: int | None, seed: int = SEED) -> Draw:
    """The first four groups of eight digits of the SHA-256 of ``seed:doc_id``; nothing after the colon for a null id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return Draw(*(int(digits[k : k + 8], 16) for k in range(0, 32, 8)))


class Formatted(NamedTuple):
    """``prefix_chars`` and ``middle_chars`` are None for a plain text."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def fill_middle(text: str, numbers: Draw, rate: int = RATE, spm_rate: int = SPM_RATE) -> Formatted:
    """``text`` as it is (plain), or rearranged with sentinels (psm or spm)."""
    tree = rope(text)
    n = tree.units
    if not text or numbers.form % 100 >= rate or SENTINEL.search(text):
        return Formatted(n, "plain", None, None, text)
    low, high = sorted((numbers.first % (n + 1), numbers.second % (n + 1)))
    start, suffix = split_units(tree, high)
    prefix, middle = split_units(start, low)
    pieces = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if numbers.order % 100 < spm_rate else ("psm", (PREFIX, SUFFIX, MIDDLE))
    out: Rope = EMPTY
    for mark in order:
        out = joined(joined(out, Leaf(mark, ())), pieces[mark])
    return Formatted(n, form, prefix.chars, middle.chars, flat(out))


def restore(output: str, form: str) -> str:
    """The text that ``fill_middle`` was given, from its output and form.

    The pieces hold no sentinel, and none can arise where two meet, so each sentinel is found once.
    """
    if form == "plain":
        return output
    pieces, rest = {}, rope(output)
    for found in reversed(list(SENTINEL.finditer(output))):
        rest, piece = split_chars(rest, found.start())
        pieces[found[0]] = split_chars(piece, len(found[0]))[1]
    return flat(joined(joined(pieces[PREFIX], pieces[MIDDLE]), pieces[SUFFIX]))


def format_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with ``fim``, a struct of n, form, prefix_chars, middle_chars, output and restored.

    A null text is empty: plain, without units. What is drawn depends on the id only, so
    repeated ids are cut alike; null ids share one draw. Rows, columns and their order
    stay; a column ``fim`` of the input is replaced.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "fim"]
    made = T.StructType([
        T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()), T.StructField("restored", T.StringType()),
    ])
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("fim", made)])
    ids, texts = rest.index(id_col), rest.index(text_col)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(ids).to_pylist(), batch.column(texts).to_pylist(), strict=True):
                got = fill_middle(text or "", draw(i, seed), rate, spm_rate)
                rows.append((*got, restore(got.output, got.form)))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, made.names)], names=schema.names)

    return docs.select(*rest).mapInArrow(add, schema)


def digest(formatted: DataFrame) -> DataFrame:
    """The hashes of output and restored text in place of them."""
    f = lambda name: F.col(f"fim.{name}")
    kept = [f(c).alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")]
    return formatted.select("doc_id", *kept, F.sha2(f("output"), 256).alias("output_sha256"), F.sha2(f("restored"), 256).alias("restored_sha256"))
