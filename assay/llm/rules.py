"""Quality rules with risk-controlled thresholds (operator 10).

Base figures of a text are exact counts.  On top of the fixed base rules, every learned rule "feature above cutoff" gets,
per stratum, the lowest cutoff of a fixed grid for which the labelled holdout proves that it rejects at most a share
``alpha / rules`` of good documents: the exact (Clopper-Pearson) upper bound of the false rejection rate, at a confidence
corrected for all stratum, rule and cutoff combinations tested (Bonferroni).  With probability ``1 - delta`` the
learned rules together then reject at most ``alpha`` of the good documents of every stratum.  Where the holdout is too
small to prove anything, a rule has no cutoff and rejects nothing.

Everything runs as DataFrame expressions.  The per-text work needs no shuffle; the holdout is reduced to one row per
stratum before any cutoff is judged, and strata (``stratum`` column) are few by contract.

Edge cases: a null text has no words and fails the base rules; a null stratum is a stratum of its own; documents with two
labels count as good only if all of them are; without labels no learned rule applies; repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import settle, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\u000b\f\r"
#: Learned rules: the feature and its grid of cutoffs, lowest first.  A document above the cutoff is rejected.
GRIDS: dict[str, list[float]] = {
    "symbol_ratio": [0.05, 0.1, 0.2, 0.4, 0.8, 1.6],
    "dup_line_ratio": [0.05, 0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_ratio": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "mean_word_chars": [6.0, 7.0, 8.0, 10.0, 12.0, 16.0],
}
#: Terms of the binomial tail that are summed; a bound of the rest is added.
TAIL_TERMS = 20_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more; all such windows count, the first one too."""
    def covered(starts: Column) -> Column:
        def step(acc, p):
            return F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def repeated(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def starts(h: Column) -> Column:
            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            twice = _let(pairs, lambda s: F.filter(s, lambda x, j: (
                F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
                    .otherwise(covered(starts(h))))

    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(repeated(w))).cast("long")


def text_figures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``keep`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` (all long)."""
    t = F.col("__text")
    rows = docs.select(*keep, text_or_empty(text).alias("__text"))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    packed = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("rep")))
    counted = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return rows.select(
        *keep, packed.alias("__w"), counted.alias("__l"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    ).select(*keep, F.col("__w.n_words").alias("n_words"), "word_chars", "n_symbols",
             F.col("__l.dup").alias("n_dup_lines"), F.col("__w.rep").alias("n_repeat_words"),
             F.col("__l.n").alias("n_lines"))


def base_failed(min_words: int = 50, repeat_pct: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbol_ratio": F.col("n_symbols") / words,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeat_ratio": F.col("n_repeat_words") / words,
            "mean_word_chars": F.col("word_chars") / words}


def _ln_factorial(x: Column) -> Column:
    """Stirling's series at ``x + 10``, less the ten factors in between: exact to about 1e-10."""
    z = x.cast("double") + 10
    series = z * F.log(z) - z + 0.5 * F.log(2 * 3.141592653589793 * z) + 1 / (12 * z) - 1 / (360 * z * z * z) \
        + 1 / (1260 * z * z * z * z * z)
    return series - reduce(lambda a, b: a + b, [F.log(x.cast("double") + i) for i in range(1, 11)])


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) and ``k < n p`` (else 1), never below the exact value by more than rounding.

    Summed from the term at ``k`` downwards, where terms shrink; a geometric bound of what lies below is added.
    """
    odds = (1 - p) / p
    top = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    last = F.least(k, F.lit(TAIL_TERMS)).cast("int")

    def step(acc, i):
        term = acc["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    ratio = (k - last) / (n - k + last + 1).cast("double") * odds
    steps = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, zero, step, lambda a: a["total"] + a["term"] * ratio / (1 - ratio))
    return F.when(k.cast("double") < n * p, F.exp(top) * total).otherwise(F.lit(1.0))


def fit_cutoffs(figures: DataFrame, labels: DataFrame, key: str, stratum: str, alpha: float = 0.04,
                delta: float = 0.05) -> DataFrame:
    """``stratum, rule, cutoff``: the proven cutoffs.  ``labels`` has ``key`` and a boolean ``good``."""
    good = labels.groupBy(key).agg(F.min("good").alias("good")).where("good")
    f = features()
    tests = [(rule, c) for rule, grid in GRIDS.items() for c in grid]
    counts = figures.where(~base_failed()).join(good.select(key), key, "left_semi").groupBy(
        F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"),
                           F.sum(F.when(f[r] > c, 1).otherwise(0)).alias("k")) for r, c in tests]).alias("t"))
    strata = settle(counts, "rule-counts")
    m = strata.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("m")).first()["m"] * len(tests)
    tested = strata.select("stratum", "n", F.explode("t").alias("t")).select("stratum", "n", "t.*")
    p = binomial_tail(F.col("n"), F.col("k"), alpha / len(GRIDS))
    return tested.withColumn("p_value", p).where(F.col("p_value") <= delta / m).groupBy("stratum", "rule").agg(
        F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """Figures of every document, ``base_failed``, ``rule`` (the first learned rule it breaks, else null) and ``kept``.

    The cutoffs (a row per stratum) are joined to the figures, broadcast only while Spark finds them small.
    """
    figures = settle(text_figures(docs, text, (key,) if key == stratum else (key, stratum)), "figures")
    cutoffs = fit_cutoffs(figures, labels, key, stratum, alpha, delta).groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in GRIDS])
    f = features()
    broken = F.coalesce(*[F.when(f[r] > F.col(f"__{r}"), F.lit(r)) for r in GRIDS])
    judged = figures.join(settle(cutoffs, "cutoffs"), F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    return judged.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed().alias("base_failed"), broken.alias("rule"),
                         (~base_failed() & broken.isNull()).alias("kept"))
