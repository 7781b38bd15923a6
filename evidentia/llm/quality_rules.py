"""Quality rules: text statistics, with cutoffs whose risk is controlled. Column expressions only.

Each statistic is a rule: a document whose value passes the cutoff is rejected. On labelled documents, per stratum and for every cutoff of a ladder, the
exact binomial tail says how likely so few false rejections would be if the true rate were above the allowed one. A cutoff is certified if that stays
below delta divided by the number of all tests (Bonferroni), so that with probability 1 - delta every rule in every stratum holds its rate, whichever of
them is then chosen. The strictest certified cutoff is used whose labelled rejections are mostly bad documents; none, if there is none.

Statistics are computed within a row, without a shuffle; they are written once, and labels and cutoffs join them by id and stratum.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SPACE = " \t\n\x0b\x0c\r"
BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Allowed false rejections over all rules, and the probability that one of them is passed.
ALPHA, DELTA = 0.02, 0.05
#: Tails of more terms are summed downwards from the largest, as far as terms count in double precision.
TERMS = 10_000
#: Strata whose cutoffs are broadcast at most.
STRATA = 10_000
#: Statistics in thousandths; a document passes a rule up to the cutoff.
RULES = ("symbols", "duplicate_lines", "repeats", "word_length")
LADDERS = {
    "symbols": (5, 10, 20, 30, 50, 80, 120, 200, 300, 500),
    "duplicate_lines": (50, 100, 150, 200, 300, 400, 500, 600, 700, 800),
    "repeats": (50, 100, 150, 200, 250, 300, 350, 400, 450, 500),
    "word_length": (6000, 7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000, 50000),
}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once: the optimizer would otherwise repeat it in every lambda that refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in order."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK))


def _covered(starts: Column) -> Column:
    """Words in the three-word windows that begin at these places."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2))))).cast("long")


def _repeated_among(words: Column, starts: Column) -> Column:
    """Words in windows at these places of which an equal one is among them, by sorting the windows themselves."""
    window = F.transform(starts, lambda p: F.struct(F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("p")))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    return _let(F.array_sort(window), lambda s: _covered(F.transform(F.filter(s, lambda x, k: ((k > 0) & same(x, F.get(s, k - 1))) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))), lambda x: x["p"])))


def repeated_words(words: Column) -> Column:
    """Words that are in a three-word window which the text has twice or more; the first time counts too.

    Hashes of windows are compared first: without two equal ones there is nothing to count. The windows of equal hashes are then compared themselves.
    """

    def among(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(places, lambda p: F.xxhash64(F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)))

        def by_hash(h: Column) -> Column:
            twice = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == F.get(s, k - 1)))))

            def count(d: Column) -> Column:
                few = F.filter(places, lambda p: F.array_contains(d, F.get(h, p)))
                return F.when(F.size(d) == 0, F.lit(0).cast("long")).when(F.size(d) <= 64, _repeated_among(w, few)).otherwise(_repeated_among(w, places))

            return _let(twice, count)

        return _let(hashes, by_hash)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(among(words))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", whole: bool = False) -> DataFrame:
    """(id_col, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of each row; with whole, also the row itself as `row`.

    A null or empty text has no words. Rows that repeat stay; a null stratum is the stratum ''; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    found = docs.select(
        F.col(id_col),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        _let(words_of(text), of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.when(text.rlike(SYMBOLS), F.regexp_count(text, F.lit(SYMBOLS))).otherwise(0).cast("long").alias("n_symbols"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []),
    )
    return found.select(*(["row"] if whole else []), id_col, "stratum", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def values() -> dict[str, Column]:
    """Each rule's statistic in whole thousandths; 0 where there is nothing to divide by."""
    share = lambda a, b: F.coalesce(F.expr(f"{a} * 1000 div nullif({b}, 0)"), F.lit(0))
    return dict(zip(RULES, (share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("word_chars", "n_words")), strict=True))


def tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for a binomial X of n trials at `rate`, at most a half, exact to rounding; 1 where k >= n * rate.

    Up to TERMS terms are summed upwards from 0. Beyond, P(X = k) is Stirling's series in Loader's form, and terms are summed downwards from k: the one j
    places lower is at most exp(-j (j - 1) / (2 k)) of it, so that those more than 10 sqrt(k) places lower are below double precision.
    """
    odds, none = F.log(F.lit(rate / (1 - rate))), F.log(F.lit(1 - rate))
    step = lambda s, i: F.struct((s["t"] + F.log((n - i + 1) / i) + odds).alias("t"), (s["p"] + F.exp(s["t"] + F.log((n - i + 1) / i) + odds)).alias("p"))
    exact = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct((n * none).alias("t"), F.exp(n * none).alias("p")), step, lambda s: s["p"])
    stirling = lambda x: 1 / (12 * x) - 1 / (360 * x * x * x)
    # x log(x / mean) + mean - x
    off = lambda x, mean: x * F.log1p((x - mean) / mean) - (x - mean)
    a, b, c = k.cast("double"), (n - k).cast("double"), n.cast("double")
    largest = F.exp(stirling(c) - stirling(a) - stirling(b) - off(a, c * rate) - off(b, c * (1 - rate))) * F.sqrt(c / (2 * math.pi * a * b))
    down = lambda s, i: F.struct((s["t"] * i / (n - i + 1) * ((1 - rate) / rate)).alias("t"), (s["p"] + s["t"] * i / (n - i + 1) * ((1 - rate) / rate)).alias("p"))
    places = F.when(k > TERMS, F.sequence(k, k - F.ceil(10 * F.sqrt(a)) - 2, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    share = F.aggregate(places, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("p")), down, lambda s: s["p"])
    return F.when(k >= n * rate, 1.0).when(k <= TERMS, F.least(F.lit(1.0), exact)).otherwise(F.least(F.lit(1.0), largest * share))


def cutoffs(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column per rule): the certified cutoff, null where there is none.

    labels: (id_col, label_col), 1 being good; of several for a row the largest counts, null is no label. Labelled documents are counted per stratum,
    rule and step of the ladder that their value passes, so that what is gathered has a fixed number of rows per stratum.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).filter(f"label in (0, 1) and {id_col} is not null").groupBy(id_col).agg(F.max("label").alias("label"))
    found = stats.join(known, id_col)
    steps = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(k).alias("step"), F.lit(c).cast("long").alias("cutoff"), (value > c).cast("int").alias("over")) for rule, value in values().items() for k, c in enumerate(LADDERS[rule])])
    counts = found.select("stratum", "label", F.explode(steps).alias("s")).groupBy("stratum", "s.rule", "s.cutoff").agg(
        F.sum("label").alias("n"), F.sum(F.col("label") * F.col("s.over")).alias("k"), F.sum((1 - F.col("label")) * F.col("s.over")).alias("bad")
    )
    strata = known.join(stats.select(id_col, "stratum"), id_col).agg(F.count_distinct("stratum").alias("strata"))
    tests = F.lit(sum(map(len, LADDERS.values())))
    # one row: the number of strata
    level = counts.withColumn("strata", strata.scalar())
    certified = level.filter((F.col("n") > 0) & (F.col("bad") > F.col("k")) & (tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= delta / (F.col("strata") * tests)))
    return certified.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(rule) for rule in RULES])


def _verdicts(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats with base_failed and kept. The cutoffs are broadcast if there are at most STRATA of them; otherwise they are joined as they come."""
    limits = materialise(limits)
    side = F.broadcast(limits) if limits.count() <= STRATA else limits
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = stats.join(side, "stratum", "left").withColumn("base_failed", failed)
    kept = ~F.col("base_failed")
    for rule, value in values().items():
        kept = kept & F.coalesce(value <= F.col(rule), F.lit(True))
    return joined.withColumn("kept", kept)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judge() keeps. Statistics are written beside their rows, so that no text is shuffled."""
    stats = materialise(statistics(docs, id_col, text_col, stratum_col, whole=True))
    return _verdicts(stats, cutoffs(stats.drop("row"), labels, id_col, label_col, alpha, delta)).filter("kept").select("row.*")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Statistics of each row with base_failed and kept.

    base_failed: fewer than 50 words, or more than half of them repeated. kept: it passed that and the certified cutoffs of its stratum. A stratum
    without labels has none. Null or empty texts fail; every row stays; an empty table gives an empty result.
    """
    stats = materialise(statistics(docs, id_col, text_col, stratum_col))
    judged = _verdicts(stats, cutoffs(stats, labels, id_col, label_col, alpha, delta))
    return judged.select(id_col, "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
