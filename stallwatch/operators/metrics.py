"""Exact ranking and threshold metrics of scored rows, for the whole table or per group in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwatch.functions.tails import normal_two_sided, student_two_sided
from stallwatch.plans.ordered import running_totals
from stallwatch.plans.skew import lookup
from stallwatch.session import cut_lineage


def _score_steps(df: DataFrame, label: str, score: str, by: Sequence[str], slices: int | None = None) -> DataFrame:
    """One row per distinct score with its positives and negatives and both cumulated from the top score down."""
    y = F.col(label).cast("long")
    steps = (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("__s"))
        .agg(F.sum(y).alias("__p"), F.sum(1 - y).alias("__q"))
    )
    steps = cut_lineage(steps)  # the scored table is read once
    return running_totals(steps, by, -F.col("__s"), {"__tp": F.col("__p"), "__fp": F.col("__q")}, slices=slices)


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), *, slices: int | None = None) -> DataFrame:
    """Average precision (step sum), ROC area (tie-averaged), and trapezoid PR area; a single class gives zeros.

    Rows without a score are left out; without groups an empty table gives one row of zeros.
    """
    steps = _score_steps(df, label, score, by, slices)
    p, q, tp, fp = (F.col(c) for c in ("__p", "__q", "__tp", "__fp"))
    before = tp - p + fp - q
    earlier = F.when(before > 0, (tp - p) / before).otherwise(1.0)
    precision = tp / (tp + fp)
    sums = steps.groupBy(*by).agg(
        F.sum(p).alias("__P"),
        F.sum(q).alias("__N"),
        F.sum(p * precision).alias("__ap"),
        F.sum(q * (tp - p / 2.0)).alias("__auc"),
        F.sum(p * (precision + earlier) / 2.0).alias("__trap"),
    )
    both = (F.coalesce("__P", F.lit(0)) > 0) & (F.coalesce("__N", F.lit(0)) > 0)
    return sums.select(
        *by,
        F.when(both, F.col("__ap") / F.col("__P")).otherwise(0.0).alias("average_precision"),
        F.when(both, F.col("__auc") / (F.col("__P") * F.col("__N"))).otherwise(0.0).alias("roc_auc"),
        F.when(both, F.col("__trap") / F.col("__P")).otherwise(0.0).alias("pr_auc_trapezoid"),
    )


def base_rates(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label).cast("long")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("positives"),
        F.sum(1 - y).alias("negatives"),
        F.avg(y.cast("double")).alias("base_rate"),
    )


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(tp > 0, 2.0 * tp / (2.0 * tp + fp + fn)).otherwise(0.0)
    return {"precision": precision, "recall": recall, "f1": f1}


def threshold_table(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] = (0.3, 0.5, 0.7, 0.9), by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and rates at each threshold (score >= threshold), in one aggregation pass."""
    y, s = F.col(label).cast("long"), F.col(score)
    one = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.coalesce(F.sum(y), F.lit(0)).alias("__pos"),
        *[F.count(F.when(s >= t, 1)).alias(f"__f{i}") for i, t in enumerate(thresholds)],
        *[F.coalesce(F.sum(F.when(s >= t, y).otherwise(0)), F.lit(0)).alias(f"__t{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(float(t)).alias("threshold"), F.col(f"__f{i}").alias("flagged"), F.col(f"__t{i}").alias("tp"))
                for i, t in enumerate(thresholds)
            ]
        )
    ).alias("r")
    flat = one.select(*by, "__n", "__pos", rows).select(*by, "__n", "__pos", "r.*")
    fp, fn = F.col("flagged") - F.col("tp"), F.col("__pos") - F.col("tp")
    tn = F.col("__n") - F.col("flagged") - fn
    return flat.select(
        *by,
        "threshold",
        "tp",
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
        *[v.alias(k) for k, v in _rates(F.col("tp"), fp, fn).items()],
        "flagged",
        F.when(F.col("__n") > 0, F.col("flagged") / F.col("__n") * 100).otherwise(0.0).alias("flagged_percent"),
    )


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix with accuracy, catch rate and false-alarm rate at one threshold."""
    t = threshold_table(df, label, score, [threshold], by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select(
        *by, "tp", "tn", "fp", "fn",
        F.when(tp + tn + fp + fn > 0, (tp + tn) / (tp + tn + fp + fn)).otherwise(0.0).alias("accuracy"),
        "precision", "recall", "f1",
        F.col("recall").alias("catch_rate"),
        F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0).alias("false_alarm_rate"),
    )


def best_threshold(
    df: DataFrame, label: str, score: str, metric: str = "f1", *, min_precision: float | None = None, min_recall: float | None = None
) -> DataFrame:
    """Best of the thresholds 0.10, 0.15 .. 0.90 under the constraints; the lowest wins ties; none gives an empty table."""
    grid = [round(0.1 + 0.05 * i, 2) for i in range(17)]
    table = threshold_table(df, label, score, grid).filter(F.col(metric) > 0)
    if min_precision is not None:
        table = table.filter(F.col("precision") >= min_precision)
    if min_recall is not None:
        table = table.filter(F.col("recall") >= min_recall)
    return table.orderBy(F.desc(metric), "threshold").limit(1).select("threshold", "precision", "recall", "f1", "tp", "fp", "fn")


def precision_at_recall(df: DataFrame, label: str, score: str, target: float) -> DataFrame:
    """Best precision among thresholds whose recall reaches the target; nulls where there is no positive."""
    steps = _score_steps(df, label, score, [])
    positives = df.filter(F.col(score).isNotNull()).agg(F.sum(F.col(label).cast("long")).alias("p")).scalar()
    tp, fp = F.col("__tp"), F.col("__fp")
    return steps.filter(tp / F.nullif(positives, F.lit(0)) >= target).agg(F.max(tp / (tp + fp)).alias("precision"), F.max("__s").alias("threshold"))


def probability_losses(df: DataFrame, label: str, score: str, by: Sequence[str] = (), eps: float | None = 1e-15) -> DataFrame:
    """Log loss and Brier score of the scored rows; a row without score adds to neither, a NaN score makes both NaN.

    Scores are kept ``eps`` away from 0 and 1. Without it they count as they are, by the logarithm of floating numbers: one that is
    no probability, or is certain and right, makes the log loss NaN (0 times infinity), one certain and wrong makes it infinite.
    """
    y, s = F.col(label).cast("double"), F.col(score)

    def ln(x: Column) -> Column:  # Spark's own gives null up to 0
        return F.when(x < 0, float("nan")).when(x == 0, float("-inf")).otherwise(F.log(x))

    # greatest and least pass over nulls and put NaN above all numbers, so both are kept out of the bounds
    p = s if eps is None else F.when(s.isNull() | F.isnan(s), s).otherwise(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), s)))
    return df.groupBy(*by).agg(
        F.avg(-(y * ln(p) + (1 - y) * ln(1 - p))).alias("log_loss"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
    )


def vendor_baseline(
    df: DataFrame, label: str, state: str, score: str, *, approve: str = "APPROVE", decline: str = "DECLINE", review: str = "REVIEW"
) -> DataFrame:
    """The vendor as a classifier: state metrics without reviewed rows, score metrics over 0-100, rates by state."""
    y = F.col(label).cast("long")
    s = F.col(state)

    def n(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    def rate(which: str, name: str) -> Column:
        return F.coalesce(F.avg(F.when(s == which, y.cast("double"))), F.lit(0.0)).alias(name)

    counts = df.agg(
        n((s == decline) & (y == 1), "tp"), n((s == decline) & (y == 0), "fp"),
        n((s == approve) & (y == 0), "tn"), n((s == approve) & (y == 1), "fn"),
        rate(decline, "decline_rate"), rate(approve, "approve_rate"), rate(review, "review_rate"),
    )
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    ranked = ranking_metrics(df.withColumn("__score", F.col(score) / 100.0), label, "__score")
    ranked = ranked.select(F.struct("roc_auc", "pr_auc_trapezoid").alias("r")).scalar()
    return counts.select(
        "tp", "fp", "tn", "fn",
        *[v.alias(f"state_{k}") for k, v in rates.items()],
        ranked["roc_auc"].alias("score_roc_auc"),
        ranked["pr_auc_trapezoid"].alias("score_pr_auc"),
        "decline_rate", "approve_rate", "review_rate",
    )


def compare_to_baseline(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Long (metric, value) tables side by side with the relative gain in percent."""
    a = model.select("metric", F.col("value").alias("model"))
    b = baseline.select("metric", F.col("value").alias("baseline"))
    gain = (F.col("model") / F.nullif(F.col("baseline"), F.lit(0.0)) - 1) * 100
    return a.join(b, "metric", "full_outer").withColumn("gain_percent", gain)


def metrics_long(one_row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn a one-row metric table into (metric, value) rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return one_row.select(F.explode(cells).alias("m")).select("m.*")


def fold_metrics(df: DataFrame, label: str, score: str, fold: str, threshold: float = 0.5) -> DataFrame:
    """Ranking and threshold metrics per fold, all folds in one job."""
    cut = confusion(df, label, score, threshold, [fold]).select(fold, "precision", "recall", "f1")
    rates = base_rates(df, label, [fold]).select(fold, "n", "base_rate")
    ranked = ranking_metrics(df, label, score, [fold])
    zeros = {c: F.coalesce(c, F.lit(0.0)) for c in ranked.columns if c != fold}  # a fold of rows without scores
    return lookup(lookup(rates, ranked, [fold], "left", null_safe=True), cut, [fold], "inner", null_safe=True).withColumns(zeros)


def paired_t_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Paired t-test of two score columns over folds: mean difference, t, degrees of freedom, two-sided p."""
    d = F.col(a) - F.col(b)
    one = df.agg(F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("__s"), F.count(d).alias("__n"))
    t = F.col("mean_difference") / F.nullif(F.col("__s") / F.sqrt("__n"), F.lit(0.0))
    stat = one.select("mean_difference", t.alias("t"), (F.col("__n") - 1).alias("dof"))
    return stat.withColumn("p_value", student_two_sided(F.col("t"), F.col("dof")))


def auc_difference_test(df: DataFrame, label: str, a: str, b: str, row_id: str) -> DataFrame:
    """DeLong test of two correlated ROC areas over the rows that both models scored.

    Placement values come from per-score cumulative counts, so no pair of rows is ever formed. With a single class, or no row scored
    by both, the areas are zero and z and p are null.
    """
    scored = df.select(row_id, F.col(label).alias("__y"), F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    scored = scored.filter("__y IS NOT NULL AND __a IS NOT NULL AND __b IS NOT NULL")
    totals = scored.agg(
        F.struct(F.nullif(F.sum(F.col("__y").cast("long")), F.lit(0)).alias("p"), F.nullif(F.sum(1 - F.col("__y").cast("long")), F.lit(0)).alias("q")).alias("t")
    ).scalar()
    rows = scored
    for column, out in (("__a", "__va"), ("__b", "__vb")):
        steps = _score_steps(scored, "__y", column, [])
        placed = steps.select(
            F.col("__s").alias(column),
            ((totals["q"] - F.col("__fp") + F.col("__q") / 2.0) / totals["q"]).alias("__v_pos"),
            ((F.col("__tp") - F.col("__p") / 2.0) / totals["p"]).alias("__v_neg"),
        )
        rows = lookup(rows, placed, [column], "inner").withColumn(
            out, F.when(F.col("__y") == 1, F.col("__v_pos")).otherwise(F.col("__v_neg"))
        ).drop("__v_pos", "__v_neg")
    sums = rows.agg(
        *[F.var_samp(F.when(F.col("__y") == y, F.col("__va") - F.col("__vb"))).alias(f"__s{y}") for y in (0, 1)],
        F.coalesce(F.avg(F.when(F.col("__y") == 1, F.col("__va"))), F.lit(0.0)).alias("auc_a"),
        F.coalesce(F.avg(F.when(F.col("__y") == 1, F.col("__vb"))), F.lit(0.0)).alias("auc_b"),
    )
    variance = F.col("__s1") / totals["p"] + F.col("__s0") / totals["q"]
    z = (F.col("auc_a") - F.col("auc_b")) / F.nullif(F.sqrt(variance), F.lit(0.0))
    return sums.select("auc_a", "auc_b", z.alias("z")).withColumn("p_value", normal_two_sided(F.col("z")))
