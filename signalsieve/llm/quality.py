"""Quality rules: a base rule, and robust multivariate outliers per language and source.

Each document becomes a vector of five transformed statistics. For every language and source a
minimum-covariance-determinant (MCD) estimate of centre and scatter is found: starting from medians
and quartiles, concentration steps take the h nearest rows by Mahalanobis distance and estimate anew
from them. A step is one aggregation over narrow rows: distances fall into fine bins, moments are
summed per bin, and the bins that hold the nearest h rows are added up. So no step sorts a group or
holds one, a source with a third of all rows combines before the shuffle, and all sums are of whole
numbers and agree from run to run. Everything is built-in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.llm.common import LOCATOR, full_text, let, located, words, written

#: Statistics are kept as whole multiples of 1/UNIT.
UNIT = 256
FEATURES = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
P = len(FEATURES)
#: What a text can resolve, per feature; squared it is added to the variances, which are 0 for shares
#: that most texts of a group lack. Sizes: 5 per cent, as a mean word length over 100 words is known no
#: better. Shares: 1 symbol in 400 characters, 1 line or word in 100. At the cutoff each feature can
#: reject below the base rule.
FLOOR = (0.05, 0.05, 0.05, 0.1, 0.1)
#: Median of a chi-square variable with P degrees of freedom.
CHI2_MEDIAN = 4.351
#: Its quantile of 0.999: distances above it are outliers.
CHI2_CUTOFF = 20.515

BASE_MIN_WORDS = 50
BASE_MAX_REPEATS = 50


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words covered by 3-word windows whose hash occurs twice or more.

    Hash and place are sorted together, equal neighbours are marked, and the marked places add up
    to the words they cover: n log n in the words of a text, however often they repeat.
    """

    def covered(sorted_places: Column) -> Column:
        def twice(pair: Column, k: Column) -> Column:
            before, after = F.get(sorted_places, k - 1), F.get(sorted_places, k + 1)
            return F.coalesce(before["h"] == pair["h"], F.lit(False)) | F.coalesce(after["h"] == pair["h"], F.lit(False))

        marked = F.sort_array(F.transform(F.filter(sorted_places, twice), lambda pair: pair["i"]))
        return let(
            marked,
            lambda at: F.aggregate(
                F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, covered)).otherwise(F.lit(0))


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds the counts of ``text`` (null: no words) to a frame without such columns."""
    text = full_text()
    three = lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("_words", words(text))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn(
            "_windows",
            F.when(
                F.col("n_words") >= 3,
                F.transform(F.slice("_words", F.lit(1), (F.col("n_words") - 2).cast("int")), three),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", _repeat_words(F.col("_words"), F.col("_windows")).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < BASE_MIN_WORDS)
            | (100 * F.col("n_repeat_words") > BASE_MAX_REPEATS * F.col("n_words")),
        )
        .drop("_words", "_lines", "_windows")
    )


#: The group of rows that are too few for an estimate of their own; others have JSON names.
ALL = "all"


def with_features(counted: DataFrame) -> DataFrame:
    """Adds the transformed statistics: logarithms of sizes, square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    values = (
        F.log(n.cast("double")),
        F.log(chars / n),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return counted.withColumns({c: F.round(v * UNIT).cast("long") for c, v in zip(FEATURES, values)})


def _whitener(table: DataFrame) -> DataFrame:
    """From means ``m0..`` and covariances ``c00, c10, ..`` the inverse Cholesky factor ``w00, ..``.

    The floor is added to the variances, so that the factor exists in every group.
    """
    for i in range(P):
        floor = float((FLOOR[i] * UNIT) ** 2)
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (floor if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            table = table.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(P):
        table = table.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, P):
            total = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            table = table.withColumn(f"w{i}{j}", -total / F.col(f"l{i}{i}"))
    return table.select("group", *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i in range(P) for j in range(i + 1)))


def _distance2() -> Column:
    parts = [
        sum((F.col(f"w{i}{j}") * (F.col(FEATURES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        for i in range(P)
    ]
    return sum((part * part for part in parts), F.lit(0.0))


def _bin(distance2: Column) -> Column:
    """Bins of 1/16 of an octave."""
    return F.floor(16 * F.log2(distance2 + F.lit(2.0**-10))).cast("int")


def _binned(rows: DataFrame, *sums: Column) -> DataFrame:
    """``sums`` per group and bin. The two are one key, so that what the tasks have summed for a
    large group meets bin by bin and not all in one place."""
    at = F.struct("group", _bin(_distance2()).alias("bin")).alias("_at")
    return rows.groupBy(at).agg(*sums).withColumns({"group": F.col("_at.group"), "bin": F.col("_at.bin")}).drop("_at")


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile distances, without correlations. Exact: values are few whole numbers."""
    quarters = rows.groupBy("group").agg(*(F.percentile(c, [0.25, 0.5, 0.75]).alias(f"q{i}") for i, c in enumerate(FEATURES)))
    means = {f"m{i}": F.col(f"q{i}")[1] for i in range(P)}
    spread = {f"c{i}{i}": F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) for i in range(P)}
    none = {f"c{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)}
    return _whitener(quarters.withColumns(means | spread | none))


def _concentrate(rows: DataFrame, estimate: DataFrame, inner: float) -> DataFrame:
    """One concentration step: the estimate from the share ``inner`` of nearest rows per group."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    bins = _binned(
        rows.join(estimate, "group"),
        F.count("*").alias("n"),
        *(F.sum(c).alias(f"s{i}") for i, c in enumerate(FEATURES)),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in pairs),
    )
    # A few hundred bins per group at most.
    nearer = Window.partitionBy("group").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        bins.withColumn("_before", F.coalesce(F.sum("n").over(nearer), F.lit(0)))
        .withColumn("_all", F.sum("n").over(Window.partitionBy("group")))
        .filter(F.col("_before") < F.col("_all") * inner)
        .groupBy("group")
        .agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(P)), *(f"p{i}{j}" for i, j in pairs)]))
    )
    means = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)}
    around = {f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in pairs}
    return _whitener(sums.withColumns(means).withColumns(around))


def _scale(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds ``scale`` per group: what brings the median distance to that of a normal vector.

    At least 1: features without scatter add nothing to the median distance, which must not shrink
    the scatter of the others.
    """
    bins = _binned(rows.join(estimate, "group"), F.count("*").alias("n"))
    nearer = Window.partitionBy("group").orderBy("bin")
    median = (
        bins.withColumn("_upto", F.sum("n").over(nearer))
        .withColumn("_all", F.sum("n").over(Window.partitionBy("group")))
        .filter(2 * F.col("_upto") >= F.col("_all"))
        .groupBy("group")
        .agg((F.pow(F.lit(2.0), (F.min("bin") + 1) / 16) / CHI2_MEDIAN).alias("scale"))
    )
    return estimate.join(median.withColumn("scale", F.greatest("scale", F.lit(1.0))), "group")


def mcd_estimates(rows: DataFrame, inner: float = 0.75, steps: int = 5) -> DataFrame:
    """Centre, inverse scatter factor and scale per ``group`` of rows with the features."""
    estimate = written(_start(rows), "mcd")
    for _ in range(steps):
        estimate = written(_concentrate(rows, estimate, inner), "mcd")
    return written(_scale(rows, estimate), "mcd")


def judge(
    docs: DataFrame, cutoff: float = CHI2_CUTOFF, min_group: int = 100, inner: float = 0.75, steps: int = 5,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source), with counts and verdict.

    Returns doc_id, ``extra`` columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, base_failed, distance (squared Mahalanobis distance, or null), kept. A null
    text has no words; null languages and sources are groups of their own. Rows that fail the base
    rule take no part in estimates. Rows with a distance over ``cutoff`` are outliers. Sources with under ``min_group`` rows of a language are
    estimated together; if these are still too few, they are measured by an estimate of all rows of
    the table. Only where the whole table has fewer rows than that, distance is null and nothing but the base
    rule rejects. Other columns are not read; an empty table gives an empty result.
    """
    key = lambda *c: F.to_json(F.struct(*c))  # noqa: E731  absent fields are nulls
    rows = written(
        with_features(with_statistics(docs.select("doc_id", "text", "lang", "source", *extra))).drop("text"), "statistics"
    )
    sizes = written(rows.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("_n")), "sizes")
    enough = (sizes.agg(F.sum("_n")).first()[0] or 0) >= min_group
    large = F.col("_n") >= min_group
    few = F.sum(F.when(large, 0).otherwise(F.col("_n"))).over(Window.partitionBy("lang"))
    groups = written(
        sizes.withColumn("_few", few).select(
            F.col("lang").alias("_lang"),
            F.col("source").alias("_source"),
            F.when(large, key("lang", "source")).when(F.col("_few") >= min_group, key("lang")).when(F.lit(enough), F.lit(ALL)).alias("group"),
        ),
        "groups",
    )
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = rows.join(groups, same, "left").drop("_lang", "_source")
    passing = rows.filter(~F.col("base_failed"))
    fitted = passing.filter(F.col("group") != ALL).select("group", *FEATURES)
    if not groups.filter(F.col("group") == ALL).isEmpty():
        fitted = fitted.unionByName(passing.select(F.lit(ALL).alias("group"), *FEATURES))
    estimates = mcd_estimates(fitted, inner, steps)
    distance = _distance2() / F.col("scale")
    return (
        rows.join(estimates, "group", "left")
        .withColumn("distance", distance)
        .select(
            "doc_id", *extra, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
            (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
        )
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected rows, in its own columns."""
    placed, narrow, names = located(docs, "doc_id", "text", "lang", "source")
    rejected = judge(narrow, extra=LOCATOR, **options).filter(~F.col("kept")).select(*LOCATOR).toDF(*names)
    return placed.join(rejected, names, "left_anti").select(*docs.columns)
