"""Distribution drift between a reference and a current sample: PSI, KS, Jensen-Shannon, rolling checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwatch.functions.scalar import finite, probability_band, psi_label
from stallwatch.operators.aggregates import bin_index, unpivot_numbers
from stallwatch.operators.joins import compare_importance
from stallwatch.plans.ordered import numbered, running_totals
from stallwatch.plans.skew import lookup
from stallwatch.session import cut_lineage

PSI_SMOOTHING = 1e-6
JSD_SMOOTHING = 1e-10


def _sides(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    cols = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    return reference.select(F.lit(1).alias("__ref"), *cols).unionByName(current.select(F.lit(0).alias("__ref"), *cols))


REFERENCE_RANGE, JOINT_RANGE = "reference", "joint"


def binned_counts(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int, spans: Sequence[str]) -> DataFrame:
    """(span, feature, bin, width, ref, cur) for every feature and bin, empty bins included.

    Bins divide the reference range, the joint range, or each in turn. One pass finds all ranges (four
    numbers per column), one pass counts all bins; at most spans x features x bins x 2 groups leave a task.
    """
    both = _sides(reference, current, columns)
    ends = []
    for c in columns:
        value, known = F.col(f"`{c}`"), F.when(F.col("__ref") == 1, F.col(f"`{c}`"))
        ends += [F.min(known), F.max(known), F.min(value), F.max(value)]
    found = [0.0 if v is None else v for v in both.agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()]
    offset = {REFERENCE_RANGE: 0, JOINT_RANGE: 2}
    ranges = [(span, c, *found[4 * i + offset[span] : 4 * i + offset[span] + 2]) for span in spans for i, c in enumerate(columns)]
    cells = [
        F.struct(
            F.lit(span).alias("span"),
            F.lit(c).alias("feature"),
            F.when(F.col(f"`{c}`").isNotNull(), bin_index(F.col(f"`{c}`"), F.lit(lo), F.lit(hi), bins)).alias("bin"),
        )
        for span, c, lo, hi in ranges
    ]
    counted = (
        both.select("__ref", F.explode(F.array(*cells)).alias("c"))
        .select("__ref", "c.*")
        .filter(F.col("bin").isNotNull())
        .groupBy("span", "feature", "bin")
        .agg(F.sum("__ref").alias("ref"), F.sum(1 - F.col("__ref")).alias("cur"))
    )
    # The grid of all bins is fixed by the call and not by the data.
    grid = reference.sparkSession.createDataFrame(
        [(span, c, b, (hi - lo) / bins if hi > lo else 1.0 / bins) for span, c, lo, hi in ranges for b in range(bins)],
        "span string, feature string, bin int, width double",
    )
    filled = grid.join(counted, ["span", "feature", "bin"], "left").select(
        "span", "feature", "bin", "width", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("ref", "cur")]
    )
    return cut_lineage(filled)  # as many rows as the grid, read several times


def _with_totals(counts: DataFrame, span: str) -> DataFrame:
    one = counts.filter(F.col("span") == span)
    return one.join(one.groupBy("feature").agg(F.sum("ref").alias("__nr"), F.sum("cur").alias("__nc")), "feature")


def _psi_of(counts: DataFrame, bins: int) -> DataFrame:
    r = (F.col("ref") + PSI_SMOOTHING) / (F.col("__nr") + bins * PSI_SMOOTHING)
    c = (F.col("cur") + PSI_SMOOTHING) / (F.col("__nc") + bins * PSI_SMOOTHING)
    enough = (F.min("__nr") >= bins) & (F.min("__nc") >= bins)
    value = F.when(enough, F.sum((c - r) * F.log(c / r))).otherwise(0.0)
    return _with_totals(counts, REFERENCE_RANGE).groupBy("feature").agg(value.alias("psi"))


def _jsd_of(counts: DataFrame, bins: int) -> DataFrame:
    def density(count: str, total: str) -> Column:
        scale = 1.0 / F.col("width") + bins * JSD_SMOOTHING
        return (F.col(count) / F.nullif(F.col(total) * F.col("width"), F.lit(0.0)) + JSD_SMOOTHING) / scale

    p, q = density("ref", "__nr"), density("cur", "__nc")
    m = (p + q) / 2
    enough = (F.min("__nr") >= bins) & (F.min("__nc") >= bins)
    value = F.when(enough, 0.5 * F.sum(p * F.log(p / m)) + 0.5 * F.sum(q * F.log(q / m))).otherwise(0.0)
    return _with_totals(counts, JOINT_RANGE).groupBy("feature").agg(value.alias("jsd"))


def psi(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per feature over equal-width bins of the reference range.

    Current values outside that range fall into the outer bins; a side with fewer rows than bins gives 0.
    """
    found = _psi_of(binned_counts(reference, current, columns, bins, [REFERENCE_RANGE]), bins)
    return found.withColumn("label", psi_label("psi"))


def jensen_shannon(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Jensen-Shannon divergence (natural log, at most ln 2) per feature over the joint range."""
    return _jsd_of(binned_counts(reference, current, columns, bins, [JOINT_RANGE]), bins)


def kolmogorov_tail(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample KS statistic."""
    x = F.sqrt(n * m / F.nullif((n + m).cast("double"), F.lit(0.0))) * d
    steps = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def ks(reference: DataFrame, current: DataFrame, columns: Sequence[str], alpha: float = 0.05, slices: int | None = None) -> DataFrame:
    """Exact two-sample KS statistic per feature, its asymptotic p-value and the verdict at ``alpha``."""
    long = unpivot_numbers(_sides(reference, current, columns), columns, ["__ref"]).filter(F.col("value").isNotNull())
    steps = long.groupBy("feature", "value").agg(F.sum("__ref").alias("__r"), F.sum(1 - F.col("__ref")).alias("__c"))
    steps = cut_lineage(steps)
    cumulated = running_totals(steps, ["feature"], F.col("value"), {"__fr": F.col("__r"), "__fc": F.col("__c")}, slices=slices, null_keys=False)
    # One row per feature, so the broadcast is as small as the list of columns.
    totals = steps.groupBy("feature").agg(F.sum("__r").alias("n_ref"), F.sum("__c").alias("n_cur"))
    gaps = cumulated.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.max(F.abs(F.col("__fr") / F.nullif(F.col("n_ref"), F.lit(0)) - F.col("__fc") / F.nullif(F.col("n_cur"), F.lit(0)))).alias("__d"),
        F.first("n_ref").alias("n_ref"),
        F.first("n_cur").alias("n_cur"),
    )
    enough = (F.col("n_ref") >= 2) & (F.col("n_cur") >= 2)
    stat = gaps.select("feature", "n_ref", "n_cur", F.when(enough, F.col("__d")).otherwise(0.0).alias("ks_stat"))
    p = F.when((F.col("n_ref") >= 2) & (F.col("n_cur") >= 2), kolmogorov_tail(F.col("ks_stat"), F.col("n_ref"), F.col("n_cur"))).otherwise(1.0)
    return stat.withColumn("ks_p", p).withColumn("ks_drift", F.col("ks_p") < alpha)


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    prediction: str,
    features: Sequence[str],
    *,
    psi_above: float = 0.2,
    alpha: float = 0.05,
    jsd_above: float = 0.1,
    feature_psi_above: float = 0.25,
) -> DataFrame:
    """(feature, role, psi, ks_stat, ks_p, jsd, drifted) for the prediction and every feature.

    The prediction drifts when two of PSI, KS and JSD say so, a feature when its PSI passes its threshold.
    Non-finite feature values count as zero.
    """
    columns = [prediction, *features]
    clean = [F.col(prediction).cast("double").alias(prediction), *[finite(F.col(f"`{c}`")).alias(c) for c in features]]
    ref, cur = reference.select(*clean), current.select(*clean)
    counts = binned_counts(ref, cur, columns, 10, [REFERENCE_RANGE, JOINT_RANGE])
    joined = _psi_of(counts, 10).join(ks(ref, cur, columns, alpha), "feature").join(_jsd_of(counts, 10), "feature")
    is_prediction = F.col("feature") == prediction
    votes = (F.col("psi") > psi_above).cast("int") + F.col("ks_drift").cast("int") + (F.col("jsd") > jsd_above).cast("int")
    return joined.select(
        "feature",
        F.when(is_prediction, "prediction").otherwise("feature").alias("role"),
        "psi", "ks_stat", "ks_p", "jsd",
        F.when(is_prediction, votes >= 2).otherwise(F.col("psi") > feature_psi_above).alias("drifted"),
    )


def overall_drift(report: DataFrame) -> DataFrame:
    """Whether the prediction, any feature, or either drifted."""
    hit = F.col("drifted").cast("int")
    return report.agg(
        (F.coalesce(F.max(F.when(F.col("role") == "prediction", hit)), F.lit(0)) == 1).alias("prediction_drift"),
        F.coalesce(F.sum(F.when(F.col("role") == "feature", hit)), F.lit(0)).alias("drifted_features"),
        (F.max(hit) == 1).alias("overall_drift"),
    )


def importance_drift(first: DataFrame, second: DataFrame, *, percent_above: float = 50, rank_above: int = 5) -> DataFrame:
    """Change of importance and rank between two windows; large changes are flagged."""
    change = F.col("importance_2") - F.col("importance_1")
    moved = compare_importance(first, second).select(
        "*",
        change.alias("importance_change"),
        (change / (F.col("importance_1") + 1e-8) * 100).alias("importance_change_percent"),
        (F.col("rank_1") - F.col("rank_2")).alias("rank_change"),
    )
    return moved.withColumn(
        "significant", (F.abs("importance_change_percent") > percent_above) | (F.abs("rank_change") > rank_above)
    )


def band_distribution(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(probability_band(score).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def psi_of_counts(ref: list[Column], cur: list[Column]) -> Column:
    """PSI of two sides given as one count per bin; 0 if either side has fewer values than bins."""
    bins = len(ref)
    n_ref, n_cur = (reduce(lambda a, b: a + b, side) for side in (ref, cur))

    def term(r: Column, c: Column) -> Column:
        x, y = (r + PSI_SMOOTHING) / (n_ref + bins * PSI_SMOOTHING), (c + PSI_SMOOTHING) / (n_cur + bins * PSI_SMOOTHING)
        return (y - x) * F.log(y / x)

    total = reduce(lambda a, b: a + b, [term(r, c) for r, c in zip(ref, cur)])
    return F.when((n_ref >= bins) & (n_cur >= bins), total).otherwise(0.0)


def ks_of_arrays(ref: Column, cur: Column) -> Column:
    """Largest gap between the distribution functions of two arrays, by one walk over their sorted union."""
    marked = F.concat(*[F.transform(side, lambda v, i=i: F.struct(v.alias("v"), F.lit(i).alias("r"))) for i, side in ((1, ref), (0, cur))])
    n_ref, n_cur = F.size(ref).cast("double"), F.size(cur).cast("double")

    def step(a: Column, e: Column) -> Column:
        # the gap counts once all equal values are in, so it is taken when the next value differs
        gap = F.when(e["v"] == a["v"], a["gap"]).otherwise(F.greatest(a["gap"], F.abs(a["fr"] / n_ref - a["fc"] / n_cur)))
        return F.struct(e["v"].alias("v"), (a["fr"] + e["r"]).alias("fr"), (a["fc"] + 1 - e["r"]).alias("fc"), gap.alias("gap"))

    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("fr"), F.lit(0).alias("fc"), F.lit(0.0).alias("gap"))
    return F.aggregate(F.sort_array(marked), start, step, lambda a: a["gap"])


def rolling_drift(
    df: DataFrame,
    *,
    series: str,
    order: Column,
    tie: str,
    score: str,
    reference_size: int = 100,
    current_size: int = 50,
    every: int = 10,
    alpha: float = 0.05,
    anchor_at: int = 0,
) -> DataFrame:
    """Drift checks as predictions arrive, per series: (series, check_at, psi, ks_stat, ks_p, label).

    The reference is the first ``reference_size`` predictions (after ``anchor_at``, for a re-anchored
    monitor); a check compares it with the last ``current_size`` each time ``every`` more have arrived.
    A row takes part in at most ``current_size / every`` checks, so each check is a small bounded group, and the checks of a
    busy series meet its reference in as many tasks as they fill. Rows without a score are no predictions: they are not counted.
    """
    scored = df.select(series, order.alias("__o"), tie, F.col(score).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    indexed = numbered(scored, [series], F.col("__o"), [F.col(tie)], "__i")
    indexed = cut_lineage(indexed.withColumn("__i", F.col("__i") - anchor_at).filter(F.col("__i") > 0))
    def counted(prefix: str) -> list[Column]:
        """One count a bin of the reference range, all in the pass that gathers the values."""
        at = bin_index(F.col("__v"), F.col("__lo"), F.col("__hi"), 10)
        return [F.count(F.when(at == b, 1)).alias(f"{prefix}{b}") for b in range(10)]

    ends = indexed.filter(F.col("__i") <= reference_size).groupBy(series).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__k"))
    ends = cut_lineage(ends.filter(F.col("__k") == reference_size).drop("__k"))  # one row a series
    placed = lookup(indexed, ends, [series], "inner", null_safe=True)
    reference = placed.filter(F.col("__i") <= reference_size).groupBy(series).agg(F.collect_list("__v").alias("__ref"), *counted("__r"))
    i = F.col("__i")
    first = F.greatest(F.lit(reference_size), F.ceil(i / every) * every).cast("int")
    last = (F.ceil((i + current_size) / every) * every - every).cast("int")
    member = placed.filter(last >= first).withColumn("check_at", F.explode(F.sequence(first, last, F.lit(every))))
    size = indexed.groupBy(series).agg(F.max("__i").alias("__n"))
    checks = member.groupBy(series, "check_at").agg(F.collect_list("__v").alias("__cur"), *counted("__c"))
    known = lookup(reference, size, [series], "inner", null_safe=True)
    ready = lookup(checks, known, [series], "inner", null_safe=True).filter(F.col("check_at") <= F.col("__n"))
    found = ready.select(
        series, "check_at", F.size("__cur").alias("n_current"),
        psi_of_counts([F.col(f"__r{b}") for b in range(10)], [F.col(f"__c{b}") for b in range(10)]).alias("psi"), ks_of_arrays(F.col("__ref"), F.col("__cur")).alias("ks_stat"),
    )
    p = kolmogorov_tail(F.col("ks_stat"), F.lit(reference_size), F.col("n_current"))
    return found.select(series, "check_at", "psi", "ks_stat", p.alias("ks_p"), (p < alpha).alias("ks_drift"), psi_label("psi").alias("label"))
