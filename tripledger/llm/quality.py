"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Each rule gives a text one number; over its cutoff the text is rejected. Cutoffs come from a
fixed grid, and labelled documents of good quality decide which of them are allowed: with k of n
good documents of a stratum rejected, a cutoff is allowed if the exact binomial chance of so few,
were the true rate of false rejections `alpha`, is small enough. The strictest allowed cutoff of
each stratum and rule applies; where none is allowed, the rule rejects nothing there.

Guarantee: with probability 1 - delta, in every stratum at most a share alpha of good documents
is rejected. alpha is split evenly among the rules, delta among all strata and rules
(Bonferroni); along a grid the cutoffs are tested from the mildest to the strictest until the
first failure, which needs no further correction.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.text import GAP, WORD
from tripledger.sources.workdir import materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents with at most so many words sort their windows as numbers, which is faster.
SHORT = 4096

#: Rule: share of (its numerator, its denominator), both from `measures`.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "exclaims": ("n_exclaims", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
}
#: A cutoff is a multiple of 1 / GRID, from 1 / GRID to 1; a rule rejects what lies above.
GRID = 50


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more among the words.

    Windows are sorted by a hash, with their place in the low bits; neighbours of equal hash are
    compared word by word. The places found are sorted, and each covers up to three words.
    """

    def count(w: Column) -> Column:
        n = F.size(w)
        bits = F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int")
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        same = lambda i, j: (
            (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
        )
        starts = F.sequence(F.lit(0), n - 3)

        def packed(b: Column) -> Column:
            shift = F.call_function("shiftleft", F.lit(1).cast("long"), b)
            keys = F.sort_array(F.transform(starts, lambda i: window(i).bitwiseAND(-shift).bitwiseOR(i.cast("long"))))
            place = lambda k: k.bitwiseAND(shift - 1).cast("int")
            head = lambda k: k.bitwiseAND(-shift)

            def twice(s: Column) -> Column:
                def hit(k: Column, i: Column) -> Column:
                    lo, hi = F.get(s, i - 1), F.get(s, i + 1)
                    return F.coalesce((head(lo) == head(k)) & same(place(lo), place(k)), F.lit(False)) | F.coalesce(
                        (head(hi) == head(k)) & same(place(hi), place(k)), F.lit(False)
                    )

                return F.transform(F.filter(s, hit), place)

            return _let(keys, twice)

        def whole() -> Column:
            keys = F.array_sort(F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.alias("i"))))

            def twice(s: Column) -> Column:
                def hit(k: Column, i: Column) -> Column:
                    lo, hi = F.get(s, i - 1), F.get(s, i + 1)
                    return F.coalesce((lo["h"] == k["h"]) & same(lo["i"], k["i"]), F.lit(False)) | F.coalesce(
                        (hi["h"] == k["h"]) & same(hi["i"], k["i"]), F.lit(False)
                    )

                return F.transform(F.filter(s, hit), lambda x: x["i"])

            return _let(keys, twice)

        places = F.sort_array(F.when(n <= SHORT, packed(bits)).otherwise(whole()))
        covered = _let(
            places,
            lambda s: F.aggregate(
                F.transform(s, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - v, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )
        return F.when(n < 4, F.lit(0).cast("long")).otherwise(covered)

    return _let(words, count)


def _without(text: Column, chars: str) -> Column:
    """How many of the characters a text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum (null as ''), and the counts of each row; a null text counts as empty.

    n_words, word_chars (code points in words), n_symbols, n_lines (with a word), n_dup_lines
    (equal to an earlier one), n_repeat_words, n_exclaims, n_capitals (ASCII).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = _let(lines, lambda a: F.struct(F.size(a).alias("all"), F.size(F.array_distinct(a)).alias("different")))
    counts = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).alias("n_symbols"),
        _without(text, "!").alias("n_exclaims"),
        _without(text, CAPITALS).alias("n_capitals"),
        parts.alias("parts"),
        repeat_words(words_of(text)).alias("n_repeat_words"),
    )
    return counts.select(
        "*",
        F.col("parts.all").cast("long").alias("n_lines"),
        (F.col("parts.all") - F.col("parts.different")).cast("long").alias("n_dup_lines"),
    ).drop("parts")


def log_factorial(n: Column) -> Column:
    """ln n!: exact to 20, beyond by Stirling's series, whose error there is under 1e-13."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def binomial_at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate), for k under n * rate; 1 otherwise, where the exact
    value is of no use. Summed downwards from k; terms far below the precision of the sum,
    over ten standard deviations away, are left out."""
    top = (
        log_factorial(n) - log_factorial(k) - log_factorial(n - k)
        + k * F.log(F.lit(float(rate))) + (n - k) * F.log1p(F.lit(-float(rate)))
    )
    odds = (1 - rate) / rate
    steps = F.least(k, F.ceil(F.sqrt(n.cast("double")) * 10).cast("long") + 50)
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j).cast("double") / (n - k + 1 + j).cast("double") * odds
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    total = F.when(steps > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), steps - 1), start, add)["sum"]).otherwise(1.0)
    return F.when(k < n * F.lit(float(rate)), F.exp(top) * total).otherwise(1.0)


def _level(rule: str) -> Column:
    """Number of grid steps a text lies at or under, 0 to GRID + 1: it is over the cutoff c / GRID
    if the level is over c."""
    above, below = RULES[rule]
    share = F.when(F.col(below) > 0, F.ceil(F.col(above) * F.lit(GRID) / F.col(below))).otherwise(0)
    return F.least(share, F.lit(GRID + 1)).cast("int")


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n, k, p): the strictest allowed cutoff, in grid steps.

    measured: rows of `measures`; labels: doc_id, quality. A document is good if all its labels
    are 1; null ids and null labels say nothing. The table has a row per stratum and rule at most.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    held = measured.join(good.select(F.col("doc_id").alias("good_id")), F.col("id") == F.col("good_id"))
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), _level(r).alias("level")) for r in RULES])
    counts = (
        held.select("stratum", F.explode(levels).alias("x"))
        .groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level"))
        .agg(F.count("*").alias("n"))
    )
    # at most strata * rules * (GRID + 2) rows from here on
    series = counts.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("at")
    )
    series = materialize(series, "levels")
    strata = series.select("stratum").distinct().count()
    grid = series.select("stratum", "rule", "n", "at", F.explode(F.sequence(F.lit(1), F.lit(GRID))).alias("cutoff"))
    over = F.aggregate(
        F.map_entries(F.map_filter("at", lambda level, _: level > F.col("cutoff"))), F.lit(0).cast("long"), lambda a, e: a + e["value"]
    )
    tested = grid.withColumn("k", over).withColumn("p", binomial_at_most(F.col("k"), F.col("n"), alpha / len(RULES)))
    allowed = tested.where(F.col("p") <= delta / max(1, strata * len(RULES)))
    best = F.min(F.struct("cutoff", "n", "k", "p")).alias("best")
    return allowed.groupBy("stratum", "rule").agg(best).select("stratum", "rule", "best.*")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """id, the five base counts, base_failed, kept and rejected_by (rules, comma-joined, in the
    order of RULES) of every row; repeated rows stay.

    base_failed: fewer than 50 words, or over half of the words in repeated windows.
    """
    measured = materialize(measures(docs, id_col, text_col, stratum_col), "measures")
    limits = cutoffs(measured, labels, alpha, delta).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    limits = limits.withColumnsRenamed({r: f"limit_{r}" for r in RULES})
    broken = [F.when(_level(r) > F.col(f"limit_{r}"), F.lit(r)) for r in RULES]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.join(limits, "stratum", "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        (~base & F.coalesce(*broken, F.lit("")).eqNullSafe("")).alias("kept"),
        F.concat_ws(",", *broken).alias("rejected_by"),
    )
