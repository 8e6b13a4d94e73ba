"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Counts per text give ratios for which higher is worse. In each stratum (a language,
say) the labelled good documents are split by a hash of their id:

1. On the ``SELECTED`` part the lowest cutoff of each ratio's grid that no document
   exceeds is looked up.
2. The cutoffs one level and two levels above those are tested jointly on the other
   part, the looser set first: a set is certified if an exact binomial test rejects
   "more than ``risk`` of the good documents exceed one of its cutoffs". The next set
   is tested only if the one before it was certified (fixed sequence), and the strata
   share the error ``delta`` (Bonferroni).

So with probability 1 - ``delta`` at most ``risk`` of the good documents of any stratum
that pass the base rules are rejected by its cutoffs, all ratios together. A stratum
with s strata beside it needs log(delta / (s + 1)) / log(1 - risk) good documents in the
tested part at least (144 of four strata); with fewer it has no cutoff, and only the
base rules reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import SPACES, let, materialise, words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Cutoffs that are tested for each ratio, lowest first.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.01, 0.02, 0.05, 0.1, 0.2),
    "upper_ratio": (0.1, 0.15, 0.2, 0.3, 0.5),
    "exclaim_ratio": (0.05, 0.1, 0.2, 0.5, 1.0),
    "dup_line_ratio": (0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_ratio": (0.05, 0.1, 0.15, 0.2, 0.25),
    "echo_ratio": (0.05, 0.1, 0.2, 0.3, 0.5),
}
RISK = 0.03
DELTA = 0.05
#: Levels above the lowest cutoff that no selected document exceeds, in the order of the tests.
MARGINS = (2, 1)
#: A document selects cutoffs if its id's MD5 begins with one of these digits; otherwise it tests them.
SELECTED = ("0", "1", "2", "3")
#: The cutoffs of so many strata at most are broadcast.
MOST_STRATA = 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count(text: Column, characters: str) -> Column:
    """How many of the given characters ``text`` has."""
    return F.length(F.regexp_replace(text, "[^" + "".join("\\" + c if not c.isalnum() else c for c in characters) + "]+", ""))


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more in the text.

    Windows (of a power of two words) are compared by 64-bit hash, which is made from
    those of their halves. Texts without a repeated window, nearly all, need no sorting.
    """

    def covered(starts: Column) -> Column:
        step = F.transform(
            starts, lambda p, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), p - F.get(starts, k - 1)))
        )
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def starts_of(keyed: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(keyed, k)["h"] == e["h"], F.lit(False))
        twice = F.filter(keyed, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def counted(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        any_twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(any_twice, let(let(keyed, starts_of), covered)).otherwise(F.lit(0))

    def doubled(halves: Column, size: int) -> Column:
        """Counts over windows of ``window`` words, given the hashes of those of ``size`` words."""
        if size == window:
            return let(F.slice(halves, 1, F.size(ws) - window + 1), counted)
        return let(F.transform(halves, lambda h, i: F.xxhash64(h, F.get(halves, i + size))), lambda x: doubled(x, 2 * size))

    return F.when(F.size(ws) > window, let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1))).otherwise(F.lit(0))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct ``quality`` of counts (long), ratios and ``base_failed``.

    A null text has no words. Ratios with nothing to divide by are 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(ws: Column, lines: Column) -> Column:
        word_chars = F.length(F.translate(text, SPACES, ""))
        with_words = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")
        echoes = F.filter(ws, lambda w, i: F.coalesce(F.get(ws, i - 1) == w, F.lit(False)))
        n = {
            "n_words": F.size(ws),
            "word_chars": word_chars,
            "n_symbols": _count(text, SYMBOLS),
            "n_dup_lines": let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": repeated_words(ws),
            "n_lines": F.size(with_words),
            "n_upper": _count(text, UPPER),
            "n_exclaims": _count(text, "!"),
            "n_echoes": F.size(echoes),
        }
        return F.struct(*[c.cast("bigint").alias(k) for k, c in n.items()])

    counted = let(F.struct(words(text).alias("ws"), F.split(text, "\n", -1).alias("lines")), lambda p: counts(p["ws"], p["lines"]))
    out = docs.withColumn("quality", counted)
    q = lambda k: F.col("quality")[k]
    part = lambda a, b: F.when(q(b) > 0, q(a) / q(b)).otherwise(F.lit(0.0))
    ratios = {
        "symbol_ratio": part("n_symbols", "word_chars"),
        "upper_ratio": part("n_upper", "word_chars"),
        "exclaim_ratio": part("n_exclaims", "n_words"),
        "dup_line_ratio": part("n_dup_lines", "n_lines"),
        "repeat_ratio": part("n_repeat_words", "n_words"),
        "echo_ratio": part("n_echoes", "n_words"),
    }
    failed = (q("n_words") < LEAST_WORDS) | (100 * q("n_repeat_words") > MOST_REPEATED_PERCENT * q("n_words"))
    return out.withColumn("quality", F.struct("quality.*", *[c.alias(k) for k, c in ratios.items()], failed.alias("base_failed")))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    odds = math.log(p / (1 - p))

    def step(at: Column, j: Column) -> Column:
        term = F.when(j == 0, n * math.log1p(-p)).otherwise(at["term"] + F.log((n - j + 1) / F.greatest(j, F.lit(1))) + odds)
        high = F.greatest(at["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(at["total"] - high) + F.exp(term - high))).alias("total"))

    begin = F.struct(F.lit(0.0).alias("term"), F.lit(-1e300).alias("total"))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), begin, step, lambda at: F.exp(at["total"]))


def fit_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    stratum_col: str = "lang",
    label_col: str = "quality",
    risk: float = RISK,
    delta: float = DELTA,
) -> DataFrame:
    """``stratum`` and the array ``cutoffs`` in the order of GRID (null: none certified).

    The good documents are those labelled 1 that pass the base rules. Documents with
    conflicting or null labels are left out. The labelled ones are written once.
    """
    good = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.min(label_col).alias("__low"), F.max(label_col).alias("__high"))
        .where((F.col("__low") == 1) & (F.col("__high") == 1))
    )
    ratios = F.array(*[F.col("quality")[m] for m in GRID])
    held = (
        measured.where(~F.col("quality.base_failed"))
        .select(F.col(id_col).alias("__id"), F.col(stratum_col).alias("stratum"), ratios.alias("ratios"))
        .join(good, "__id", "left_semi")
        .select("stratum", "ratios", F.substr(F.md5(F.col("__id").cast("string")), F.lit(1), F.lit(1)).isin(*SELECTED).alias("selects"))
    )
    held = materialise(held, "quality-holdout")

    def level(at: int, grid: tuple[float, ...]) -> Column:
        """The lowest level that no selecting document exceeds."""
        over = lambda cut: F.count_if(F.col("selects") & (F.get("ratios", F.lit(at)) > cut))
        return F.coalesce(*[F.when(over(cut) == 0, F.lit(i)) for i, cut in enumerate(grid)], F.lit(None).cast("int"))

    levels = held.groupBy("stratum").agg(*[level(at, grid).alias(m) for at, (m, grid) in enumerate(GRID.items())])
    cuts = lambda margin: F.array(*[F.get(F.array(*map(F.lit, grid)), F.col(m) + margin) for m, grid in GRID.items()])
    sets = materialise(levels.select("stratum", *[cuts(g).alias(f"set_{g}") for g in MARGINS]), "quality-sets")
    strata = sets.count()
    joined = _with_strata(held.where(~F.col("selects")), "stratum", sets, strata)
    counts = joined.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(_exceeds(F.col("ratios"), F.col(f"set_{g}"))).alias(f"k_{g}") for g in MARGINS])

    def certified(k: Column) -> Column:
        return (k <= risk * F.col("n")) & (binomial_cdf(k, F.col("n"), risk) <= delta / max(1, strata))

    chosen = F.lit(None).cast("array<double>")
    for g in reversed(MARGINS):
        chosen = F.when(certified(F.col(f"k_{g}")), F.coalesce(chosen, F.col(f"set_{g}")))
    return _with_strata(sets, "stratum", counts, strata).select("stratum", F.coalesce(chosen, F.array_repeat(F.lit(None).cast("double"), len(GRID))).alias("cutoffs"))


def _with_strata(df: DataFrame, stratum_col: str, strata: DataFrame, rows: int) -> DataFrame:
    """``df`` with the columns of its stratum's row of ``strata`` (of ``rows`` rows): a broadcast if they are few."""
    own = strata.withColumnRenamed("stratum", "__stratum")
    return df.join(F.broadcast(own) if rows <= MOST_STRATA else own, df[stratum_col].eqNullSafe(own["__stratum"]), "left").drop("__stratum")


def _exceeds(ratios: Column, cutoffs: Column) -> Column:
    """Whether a ratio is above its cutoff; a null cutoff sets no limit."""
    out = F.lit(False)
    for at in range(len(GRID)):
        out = out | F.coalesce(F.get(ratios, F.lit(at)) > F.get(cutoffs, F.lit(at)), F.lit(False))
    return out


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``measured`` with ``kept``: passes the base rules and exceeds no certified cutoff.

    ``cutoffs``, a row a stratum, is written and counted, then joined.
    """
    limits = materialise(cutoffs.select("stratum", F.col("cutoffs").alias("__cutoffs")), "quality-cutoffs")
    joined = _with_strata(measured, stratum_col, limits, limits.count())
    ratios = F.array(*[F.col("quality")[m] for m in GRID])
    return joined.withColumn("kept", ~F.col("quality.base_failed") & ~_exceeds(ratios, F.col("__cutoffs"))).drop("__cutoffs")


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality"
) -> DataFrame:
    """``docs`` with ``quality`` (counts and ratios) and ``kept``.

    The measured rows are written once, so each text is read and measured once.
    Null ids and strata are allowed (a null stratum is one of its own), repeated
    rows are judged alike, empty tables give empty results and further columns
    pass through (a column ``quality`` or ``kept`` of ``docs`` is replaced).
    """
    measured = materialise(measure(docs.drop("quality", "kept"), text_col), "quality")
    return judge(measured, fit_cutoffs(measured, labels, id_col, stratum_col, label_col), stratum_col)
