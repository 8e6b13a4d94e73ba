"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a reference text is built. A text is
parsed into phrases, each the longest match in the reference; the language whose
reference needs the fewest phrases, normalised by the references' lengths, wins.

The references are a bounded sample of the labelled rows: at most ``SAMPLED`` whole
texts a language, none longer than ``LONGEST`` characters where a language has such, and
no more than ``MOST_CHARS`` together. Transitions on a language's most frequent symbols
are a table of ``MOST_CELLS`` cells at most, those on the others sorted edges, so a large
alphabet takes no more memory than a small one.
Every document is parsed whole. NumPy advances windows of ``WINDOW`` characters side by
side; then each window is parsed again from the state in which the one before it ended,
as far as that changes anything, so the phrases are those of one parse from begin to end.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import small_batches

#: Bound of the sample: texts a language, and their characters where there are texts as short.
SAMPLED = 32
LONGEST = 2_000
#: Characters of a language's sample together; a longer text is never sampled.
MOST_CHARS = 1 << 18
WINDOW = 128
#: Cells of the table of a language's frequent symbols.
MOST_CELLS = 1 << 23
#: Times that all windows are parsed side by side before the rest is parsed from one end to the other.
MOST_ROUNDS = 4
#: Symbols of the texts that are parsed at once, unless one text is longer.
MOST_SYMBOLS = 1 << 21
UNDETERMINED = "und"

_MODELS: dict[tuple, Model] = {}


def letters(text: str) -> str:
    """Lower-case letters with one space for whatever stands between them."""
    kept = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower())
    return " ".join(kept.split())


class SuffixAutomaton:
    """All substrings of a text: ``next[state]`` maps a symbol to the state after it."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, longest, last = [-1], [0], 0
        for symbol in text:
            new = len(self.next)
            self.next.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = link[at]
            if at >= 0:
                there = self.next[at][symbol]
                if longest[at] + 1 == longest[there]:
                    link[new] = there
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[there]))
                    longest.append(longest[at] + 1)
                    link.append(link[there])
                    while at >= 0 and self.next[at].get(symbol) == there:
                        self.next[at][symbol] = copy
                        at = link[at]
                    link[there] = link[new] = copy
            last = new


class Moves:
    """Transitions of a reference's automaton on numbered symbols.

    A move is 2 * (next state) + (1 if a phrase begins here). Symbol 0 fills windows up and
    changes nothing, 1 is any symbol that no reference has.
    """

    def __init__(self, text: str, number: dict[str, int], symbols: int, most_cells: int = MOST_CELLS):
        automaton = SuffixAutomaton(text)
        self.outside = len(automaton.next)  # the state in which the next symbol begins a phrase
        used = [c for c, _ in Counter(text).most_common()]
        self.width = 2 + min(len(used), max(1, most_cells // (self.outside + 1)))
        frequent, rare = used[: self.width - 2], used[self.width - 2 :]
        self.column = np.ones(symbols, np.int32)  # of each symbol; from ``width`` on those without a column of the table
        self.column[0] = 0
        for k, c in enumerate(frequent + rare):
            self.column[number[c]] = k + 2
        place = {c: k + 2 for k, c in enumerate(frequent)}
        apart = {c: k for k, c in enumerate(rare)}
        self.n_rare = len(rare)
        table = np.full((self.outside + 1, self.width), -1, np.int32)
        keys, targets = [], []
        for state, moves in enumerate(automaton.next):
            for symbol, to in moves.items():
                if symbol in place:
                    table[state, place[symbol]] = 2 * to
                else:
                    keys.append(state * self.n_rare + apart[symbol])
                    targets.append(2 * to)
        restart = np.where(table[0] < 0, 2 * self.outside, table[0]) + 1  # a symbol that the reference lacks is a phrase of its own
        table = np.where(table < 0, restart, table).astype(np.int32)
        table[:, 0] = 2 * np.arange(len(table))
        self.table = table.ravel()
        order = np.argsort(keys) if keys else np.zeros(0, np.int64)
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]
        self.restart = np.array([2 * automaton.next[0][c] + 1 for c in rare], np.int32)

    def take(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The moves from ``state`` on symbols given by their ``column``."""
        if not self.n_rare:
            return self.table.take(state * self.width + column)
        apart = column >= self.width
        out = self.table.take(state * self.width + np.where(apart, 1, column))
        at = np.flatnonzero(apart)
        if len(at):
            symbol = column[at] - self.width
            key = state[at].astype(np.int64) * self.n_rare + symbol
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[at] = np.where(self.keys[near] == key, self.targets[near], self.restart[symbol])
        return out

    def one(self, state: int, column: int) -> int:
        if column < self.width:
            return int(self.table[state * self.width + column])
        key = state * self.n_rare + column - self.width
        near = int(np.searchsorted(self.keys, key))
        return int(self.targets[near] if near < len(self.keys) and self.keys[near] == key else self.restart[column - self.width])


class Model:
    """The languages' automata over one numbering of symbols."""

    def __init__(self, references: tuple[tuple[str, str], ...], most_cells: int = MOST_CELLS):
        self.languages = [lang for lang, _ in references]
        alphabet = sorted(set("".join(text for _, text in references)) | {" "})
        self.symbols = len(alphabet) + 2
        number = {c: k + 2 for k, c in enumerate(alphabet)}
        # code point -> symbol of its lower-case form; letters that no reference has are 1
        self.symbol_of = np.full(0x110000, number[" "], np.min_scalar_type(self.symbols))
        self.is_letter = np.zeros(0x110000, bool)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha() or unicodedata.category(c)[0] == "M":
                self.is_letter[point] = c.isalpha()
                self.symbol_of[point] = number.get(c.lower(), 1)
        self.space = number[" "]
        self.moves = [Moves(text, number, self.symbols, most_cells) for _, text in references]
        self.weights = [np.log2(max(2, len(text))) for _, text in references]

    def codes(self, text: str) -> np.ndarray | None:
        """A text's symbols with single spaces; None if it has no letter."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not self.is_letter[points].any():
            return None
        symbols = self.symbol_of[points]
        gap = symbols == self.space
        return symbols[~(gap & np.r_[True, gap[:-1]])]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) in each language (column)."""
        windows = [-(-len(t) // WINDOW) for t in texts]
        owner = np.repeat(np.arange(len(texts)), windows)
        lanes = np.zeros(sum(windows) * WINDOW, texts[0].dtype)
        at = 0
        for t, n in zip(texts, windows, strict=True):
            lanes[at * WINDOW : at * WINDOW + len(t)] = t
            at += n
        lanes = np.ascontiguousarray(lanes.reshape(-1, WINDOW).T)
        follows = np.r_[False, owner[1:] == owner[:-1]]  # the window goes on where the one before it ended
        out = np.zeros((len(texts), len(self.languages)))
        for k, moves in enumerate(self.moves):
            out[:, k] = np.bincount(owner, self._parse(moves, moves.column[lanes], follows), len(texts))
        return out

    def _parse(self, table: Moves, lanes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that begin in each window (column), given that windows may follow each other."""
        moves = np.empty(lanes.shape, np.int32)
        state = np.full(lanes.shape[1], table.outside, np.int32)
        for step, columns in enumerate(lanes):
            moves[step] = table.take(state, columns)
            state = moves[step] >> 1
        begun = np.full(lanes.shape[1], table.outside, np.int32)
        for _ in range(MOST_ROUNDS):
            ends = moves[-1] >> 1
            begins = np.where(follows, np.r_[table.outside, ends[:-1]], table.outside)
            lane = np.flatnonzero(begins != begun)
            if not len(lane):
                return (moves & 1).sum(0)
            begun, state = begins, begins[lane]
            for step in range(WINDOW):
                new = table.take(state, lanes[step, lane])
                other = (new >> 1) != (moves[step, lane] >> 1)
                moves[step, lane] = new
                lane, state = lane[other], new[other] >> 1  # in the same state the parses go on alike
                if not len(lane):
                    break
        # what still changes is a long run, such as one repeated letter: window after window
        for lane in range(1, lanes.shape[1]):
            state = int(moves[-1, lane - 1] >> 1)
            if follows[lane] and state != begun[lane]:
                for step in range(WINDOW):
                    new, old = table.one(state, int(lanes[step, lane])), int(moves[step, lane])
                    moves[step, lane], state = new, new >> 1
                    if state == old >> 1:
                        break
        return (moves & 1).sum(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1: how far the next language is behind) of each text."""
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        coded = {k: c for k, t in enumerate(texts) if t and (c := self.codes(t)) is not None}
        if coded:
            groups: list[list[np.ndarray]] = [[]]
            for c in coded.values():
                if groups[-1] and sum(map(len, groups[-1])) + len(c) > MOST_SYMBOLS:
                    groups.append([])
                groups[-1].append(c)
            cost = np.vstack([self.phrases(g) for g in groups]) * np.array(self.weights)
            best = cost.argmin(1)
            ordered = np.sort(cost, 1)
            lead = 1 - ordered[:, 0] / ordered[:, 1] if len(self.languages) > 1 else np.ones(len(cost))
            for k, b, s in zip(coded, best, lead, strict=True):
                langs[k], scores[k] = self.languages[b], float(s)
        return langs, scores


def _model(references: tuple[tuple[str, str], ...]) -> Model:
    if references not in _MODELS:
        _MODELS.clear()
        _MODELS[references] = Model(references)
    return _MODELS[references]


def references(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sampled: int = SAMPLED) -> tuple[tuple[str, str], ...]:
    """The reference text of each language, from a bounded sample of the rows of ``train``.

    Rows fall into ``sampled`` buckets by a hash of id and text; of each bucket the row
    with the least hash is taken whole, of those with ``LONGEST`` characters at most, or
    the shortest row if there is none. Rows without a text or a language are left out.
    """
    size = F.length(text_col)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    order = (F.greatest(size, F.lit(LONGEST)).alias("size"), key.alias("key"))
    rows = train.where(F.col(lang_col).isNotNull() & (size > 0) & (size <= MOST_CHARS)).select(
        F.col(lang_col).alias("lang"), F.pmod(key, F.lit(sampled)).alias("bucket"), F.struct(*order).alias("order"), F.col(text_col).alias("text")
    )
    picked = rows.groupBy("lang", "bucket").agg(F.min("order").alias("order"), F.min_by("text", "order").alias("text"))
    shortest = Window.partitionBy("lang").orderBy(F.length("text"), "bucket").rowsBetween(Window.unboundedPreceding, 0)  # ``sampled`` rows
    picked = picked.withColumn("so_far", F.sum(F.length("text")).over(shortest)).where(F.col("so_far") <= MOST_CHARS).select("lang", "bucket", "text")
    texts: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, picked.collect())):  # ``sampled`` rows a language at most
        texts.setdefault(lang, []).append(letters(text))
    return tuple((lang, " ".join(parts)) for lang, parts in texts.items() if any(parts))


def identify(docs: DataFrame, known: tuple[tuple[str, str], ...], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score``.

    ``und`` (score 0) if the text is null or has no letter, or if nothing was
    learned; of languages that need equally many phrases the first by name.
    Null ids and repeated rows are kept; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    rows = docs.select(*rest, text_col)
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(known)
        for batch in batches:
            langs, scores = model.predict(batch.column(len(rest)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(langs), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(predict, schema)
