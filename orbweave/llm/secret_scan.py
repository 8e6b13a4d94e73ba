"""Secret scanning with a trigram inverted index, in DataFrame operations only.

1. From each rule's regular expression a Boolean query of trigrams is derived
   that every match must satisfy (an AND of ORs of ANDs).
2. The texts are indexed for the trigrams that any rule asks for: a posting is a
   (trigram, document) pair.
3. The postings are intersected per document, which leaves candidate documents
   for each rule; rules without a mandatory trigram keep every document.
4. The regular expressions run on the candidates and give exact spans.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import before_each, blocks_of, fresh, let, materialise, span_of


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The base kinds, in the order in which spans are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + EXTRA_RULES

SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
#: Bits of the table that tells which rows may be candidates, for each of these, and at most (1,048,576 longs).
BITS_A_KEY = 16
MOST_BITS = 1 << 26
#: Above so many alternative strings a part of a pattern sets no condition.
MOST_STRINGS = 128

#: A query is an AND of clauses; a clause is an OR of sets of trigrams, each set an AND.
Query = tuple[frozenset[frozenset[str]], ...]


class _Reader:
    """Reads the part of the pattern language that Java and Python share.

    A part is what it may match: a set of strings, or None if that isn't known or too much. Beyond
    literals, classes, groups, alternatives and repeats (``?``, ``*``, ``+``, ``{m,n}``, lazy or not) it knows
    the flag ``(?i)`` at the begin and anchors, which match nothing; ValueError for all else.
    """

    def __init__(self, pattern: str):
        self.text, self.at = pattern.removeprefix("(?i)"), 0

    def _met(self, what: str) -> bool:
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def _take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"the pattern {self.text!r} ends early")
        self.at += 1
        return self.text[self.at - 1]

    def _escaped(self) -> str | None:
        """The character after a backslash; None for a class of characters."""
        c = self._take()
        if c == "x":
            return chr(int(self._take() + self._take(), 16))
        if c in "tnr":
            return {"t": "\t", "n": "\n", "r": "\r"}[c]
        if c.isalnum() and c not in "dDwWsS":
            raise ValueError(f"unknown escape: {c}")
        return None if c.isalnum() else c

    def _class(self) -> set[str] | None:
        known: set[str] | None = None if self._met("^") else set()
        first = True
        while first or not self._met("]"):
            first, c = False, self._take()
            one = self._escaped() if c == "\\" else c
            ranged = self.text[self.at : self.at + 1] == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", "")
            if ranged:
                self.at += 2
                if self.text[self.at - 1] == "\\":
                    self._escaped()
            known = None if known is None or one is None or ranged else known | {one}
        return known

    def _atom(self) -> set[str] | None:
        c = self._take()
        if c == "(":
            if self._met("?") and not self._met(":"):
                raise ValueError("unknown group")
            found = self.either()
            if not self._met(")"):
                raise ValueError("a group does not end")
            return found
        if c == "[":
            return self._class()
        if c == "\\":
            if self.text[self.at : self.at + 1] in ("b", "B"):
                self.at += 1
                return {""}
            one = self._escaped()
            return None if one is None else {one}
        if c in "*+?{":
            raise ValueError("nothing to repeat")
        return {""} if c in "^$" else None if c == "." else {c}

    def _times(self) -> tuple[int, int | None] | None:
        """How often what stands before may be repeated; None if it isn't."""
        found: tuple[int, int | None] | None = None
        if self._met("?"):
            found = (0, 1)
        elif self._met("*"):
            found = (0, None)
        elif self._met("+"):
            found = (1, None)
        elif self._met("{"):
            low, _, high = (inner := self.text[self.at : self.text.index("}", self.at)]).partition(",")
            self.at += len(inner) + 1
            found = (int(low), int(high) if high else None if "," in inner else int(low))
        if found:
            self._met("?")
        return found

    def items(self) -> list[set[str] | None]:
        """The parts of a sequence, up to its end or an alternative."""
        out = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            one, times = self._atom(), self._times()
            if times:
                low, high = times
                one = None if one is None or high is None or high > 2 else {"".join(x) for n in range(low, high + 1) for x in itertools.product(one, repeat=n)}
            out.append(one)
        return out

    def either(self) -> set[str] | None:
        parts = [_joined(self.items())]
        while self._met("|"):
            parts.append(_joined(self.items()))
        return None if None in parts else set().union(*parts)


def _joined(items: list[set[str] | None]) -> set[str] | None:
    """All strings that the parts give one after another, or None if they are too many."""
    out = {""}
    for one in items:
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(pattern: str) -> Query:
    """The trigrams (lower case) that each match of ``pattern`` must hold.

    Lower-casing the index can only add candidates, so one index serves rules
    with and without regard to case. An empty query is true for every text; patterns
    that are not understood have it.
    """
    clauses: list[frozenset[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        low = {s.lower() for s in strings}
        if all(len(s) >= 3 for s in low):
            clauses.append(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in low))

    reader, run = _Reader(pattern), {""}
    try:
        items = reader.items()
        if reader.at < len(reader.text):  # alternatives at the top
            reader = _Reader(pattern)
            items = [reader.either()]
        if reader.at < len(reader.text):
            return ()
    except ValueError:
        return ()
    for new in items:
        if new is not None and len(run) * len(new) <= MOST_STRINGS:
            run = {a + b for a in run for b in new}
        else:
            close(run)
            run = new if new is not None else {""}
    close(run)
    return tuple(clauses)


def row_key(id_col: str, text_col: str) -> Column:
    """The key of a row in the index, a hash of its id and text, so that null and repeated ids spread.

    Rows that share a key share their candidates, and each is verified on its own text.
    """
    return F.xxhash64(id_col, text_col)


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """The inverted index for ``trigrams``: ``gram`` (its number) and ``doc`` (a row's key)."""
    grams = F.array(*[F.lit(g) for g in trigrams])
    found = let(
        F.lower(F.coalesce(F.col(text_col), F.lit(""))),
        lambda low: F.filter(F.sequence(F.lit(0), F.lit(len(trigrams) - 1)), lambda k: F.contains(low, F.get(grams, k))),
    )
    return docs.select(row_key(id_col, text_col).alias("doc"), F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """``doc`` and the kinds whose query the document's postings satisfy.

    Each posting sets a bit; or-ing the bits intersects all postings of a document
    with as many longs as the rules' trigrams need. The sums are partly made before
    the shuffle, so a trigram that most documents hold does not weigh on one task.
    """
    number = {g: k for k, g in enumerate(trigrams)}
    n_longs = (len(trigrams) + 61) // 62
    bits = [
        F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("gram") % 62)).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}")
        for w in range(n_longs)
    ]

    def holds(grams: frozenset[str]) -> Column:
        masks = [0] * n_longs
        for g in grams:
            masks[number[g] // 62] |= 1 << (number[g] % 62)
        out = F.lit(True)
        for w, m in enumerate(masks):
            if m:
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(m).cast("bigint")) == F.lit(m).cast("bigint"))
        return out

    def satisfied(query: Query) -> Column:
        out = F.lit(True)
        for clause in query:
            any_of = F.lit(False)
            for grams in sorted(clause, key=sorted):
                any_of = any_of | holds(grams)
            out = out & any_of
        return out

    kinds = F.array_compact(F.array(*[F.when(satisfied(q), F.lit(r.kind)) for r in rules if (q := trigram_query(r.pattern))]))
    return index.groupBy("doc").agg(*bits).select("doc", kinds.alias("kinds")).where(F.size("kinds") > 0)


def may_be_among(docs: DataFrame, key: Column, found: DataFrame, out: str) -> DataFrame:
    """``docs`` with the flag ``out``: false if no row of ``found`` has this ``key`` as its ``doc``, true if one may.

    The keys of ``found`` set bits of a table with ``BITS_A_KEY`` times as many bits, ``MOST_BITS`` at
    most; it is broadcast. Beyond that size more rows are flagged than need be, and none is missed.
    """
    bits = min(MOST_BITS, 1 << max(6, (BITS_A_KEY * found.count()).bit_length()))
    word = lambda k: F.floor(F.pmod(k, F.lit(bits)) / 64).cast("long")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.pmod(k, F.lit(bits)) % 64).cast("int"))
    # at most MOST_BITS / 64 rows of two longs
    words = F.broadcast(found.groupBy(word(F.col("doc")).alias("__word")).agg(F.bit_or(bit(F.col("doc"))).alias("__bits")))
    held = F.coalesce(F.col("__bits"), F.lit(0).cast("bigint")).bitwiseAND(bit(key)) != 0
    return docs.join(words, word(key) == F.col("__word"), "left").withColumn(out, held).drop("__word", "__bits")


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's leftmost non-overlapping matches, in code points.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the
    matches; their running lengths are the offsets.
    """
    pattern = F.lit(rule.pattern)

    def located(between: Column, found: Column, measured: Column) -> Column:
        steps = F.transform(found, lambda x, i: (F.length(F.get(between, i)) + F.length(x)).cast("bigint"))

        def spans(before: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(between, i))
                return F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), (start + F.length(x)).alias("end"))

            counts = F.filter(F.transform(found, lambda x, i: F.struct(span(x, i).alias("span"), (F.length(F.get(measured, i)) >= rule.least).alias("kept"))), lambda s: s["kept"])
            return F.transform(counts, lambda s: s["span"])

        return let(before_each(steps, lambda a, b: a + b), spans)

    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("measured"),
    )
    return F.when(text.rlike(rule.pattern), let(parts, lambda p: located(p["between"], p["found"], p["measured"]))).otherwise(F.array().cast(SPAN))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "spans") -> DataFrame:
    """``docs`` with the column ``out``: spans (kind, start, end) of all secrets.

    Spans sort by start, then by the rules' order, then by end. A null or empty
    text has none. Null ids and repeated rows are allowed; rows are neither lost nor
    repeated. Other columns pass through; ``out`` replaces one of that name.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({g for q in queries.values() for clause in q for grams in clause for g in grams})
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = [r for r in rules if not queries[r.kind]]
    indexed = [r for r in rules if queries[r.kind]]
    if not indexed:
        return docs.withColumn(out, F.flatten(F.array(*[rule_spans(text, r) for r in full])))
    found = materialise(candidates(postings(docs, id_col, text_col, trigrams), rules, trigrams), "secret-candidates")
    key, flag = row_key(id_col, text_col), fresh(docs, "__may_hold")
    marked = may_be_among(docs, key, found, flag)
    found = found.select(F.col("doc").alias("__secret_doc"), F.col("kinds").alias("__secret_kinds"))
    # only texts that may be candidates meet them; the others stay where they are
    joined = marked.where(flag).drop(flag).join(found, key == F.col("__secret_doc"), "left")
    none = F.array().cast(SPAN)
    kinds = F.coalesce(F.col("__secret_kinds"), F.array().cast("array<string>"))
    each = [rule_spans(text, r) for r in full] + [
        F.when(F.array_contains(kinds, r.kind), rule_spans(text, r)).otherwise(none) for r in indexed
    ]
    order = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(
        F.flatten(F.array(*each)),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    others = marked.where(~F.col(flag)).drop(flag)
    verified = joined.withColumn(out, spans).drop("__secret_doc", "__secret_kinds")
    return verified.unionByName(others.withColumn(out, F.flatten(F.array(*[rule_spans(text, r) for r in full])) if full else none))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``[kind]``; overlapping spans become one, named after the first."""

    def written(blocks: Column, reached: Column) -> Column:
        """``reached``: for each span how far those before it reach."""
        first = F.filter(F.transform(spans, lambda s, i: F.struct(s["kind"].alias("kind"), F.get(reached, i).alias("from"), s["start"].alias("to"))), lambda p: p["to"] >= p["from"])
        parts = F.transform(first, lambda p: F.concat(span_of(blocks, p["from"], p["to"]), F.lit("["), p["kind"], F.lit("]")))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), span_of(blocks, end, F.greatest(end, F.length(text).cast("bigint"))))

    reached = before_each(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(F.struct(blocks_of(text).alias("b"), reached.alias("r")), lambda x: written(x["b"], x["r"]))).otherwise(text)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and listings of the spans of ``find_secrets``."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [r.kind for r in BASE_RULES]
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        F.col(id_col).alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(of_base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
