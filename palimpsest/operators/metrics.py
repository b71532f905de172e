"""Detector metrics over long tables (keys, label, score), grouped; sums over ranks are made in two steps
(see ranks), so neither a window nor a task holds a whole group.

Rows with a NULL label or score are left out. Decisions are strict: a score counts if it is over the
threshold. A metric that needs both classes is NULL where one is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions import fixed
from palimpsest.operators.lineage import cut
from palimpsest.operators.ranks import cell_of, cut_points, running


def wilson(successes: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson interval, clamped to [0, 1]; NULL for n = 0."""
    z = fixed.Z95 if alpha == 0.05 else NormalDist().inv_cdf(1 - alpha / 2)
    s, n = successes.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, d = s / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    # greatest() and least() skip NULLs
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half))


def _steps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct scores per group with their counts: what every rank metric needs, small beside the rows."""
    return df.where("label is not null and score is not null").groupBy(*keys, "score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg")
    )


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys, NULL meeting NULL; the keys are a's."""
    x, y = a.alias("_a"), b.alias("_b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}"))
    both = x.join(y, same, how) if keys else x.join(F.broadcast(y), how="left" if how == "left" else "cross")  # without keys b is one row
    return both.select(*[F.col(f"_a.{c}").alias(c) for c in a.columns], *[F.col(f"_b.{c}").alias(c) for c in b.columns if c not in keys])


def _ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """_steps() with before_neg, the negatives of lower scores, and p and q, the group's positives and
    negatives. Steps are kept, so that rows are read once."""
    steps = cut(_steps(df, keys))
    totals = steps.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return join_keys(running(steps, keys, "score", ["neg"]), totals, keys)


def _auc() -> Column:
    return F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))


def _tau(fpr: float) -> Column:
    index = F.least(F.floor(F.col("q") * F.lit(fpr)), F.col("q") - 1)
    return F.max(F.when((F.col("neg") > 0) & (F.col("q") - F.col("before_neg") > index), F.col("score")))


def _share_over(count: str, tau: Column) -> Column:
    return F.sum(F.when(F.col("score") > tau, F.col(count)).otherwise(0)) / F.nullif(F.sum(count), F.lit(0))


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, auc): the share of (positive, negative) pairs in the right order, ties half."""
    return _ranked(df, keys).groupBy(*keys).agg((F.sum("pos") + F.sum("neg")).alias("n"), _auc().alias("auc"))


def threshold_at_fpr(df: DataFrame, keys: list[str], fpr: float) -> DataFrame:
    """(keys, tau): the benign score at index min(floor(n fpr), n - 1) of the descending order."""
    return _ranked(df.where("label = 0"), keys).groupBy(*keys).agg(_tau(fpr).alias("tau")).where("tau is not null")


def rates_at(df: DataFrame, keys: list[str], thresholds: DataFrame) -> DataFrame:
    """(keys, tau, tpr, fpr) of thresholds (keys, tau)."""
    rows = join_keys(_steps(df, keys), thresholds.select(*keys, "tau"), keys)
    over = F.col("score") > F.col("tau")
    share = lambda c: F.sum(F.when(over, F.col(c)).otherwise(0)) / F.nullif(F.sum(c), F.lit(0))
    return rows.groupBy(*keys, "tau").agg(share("pos").alias("tpr"), share("neg").alias("fpr"))


def tpr_at_fpr(df: DataFrame, keys: list[str], fpr: float) -> DataFrame:
    return rates_at(df, keys, threshold_at_fpr(df, keys, fpr)).select(*keys, "tau", "tpr")


def f1_at(df: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """(keys, f1): 0 without a true positive."""
    over, y = F.col("score") > tau, F.col("label") == 1
    a = df.where("label is not null and score is not null").groupBy(*keys).agg(
        F.count(F.when(over & y, 1)).alias("tp"), F.count(F.when(over & ~y, 1)).alias("fp"), F.count(F.when(~over & y, 1)).alias("fn")
    )
    return a.select(*keys, F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


#: Values of metrics over resampled counts: (scores ascending, positives, negatives), the counts one column
#: a resample, to one value a resample; NaN where a class is missing.
Metric = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def auc_of(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return (pos * (neg.cumsum(axis=0) - neg / 2)).sum(axis=0) / (pos.sum(axis=0) * neg.sum(axis=0))


def tpr_of(fpr: float) -> Metric:
    """Recall over the threshold that leaves ``fpr`` of the negatives over it."""

    def value(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        n = neg.sum(axis=0)
        index = np.minimum(np.floor(n * fpr), n - 1)
        down = neg[::-1].cumsum(axis=0)
        place = len(scores) - 1 - (down > index).argmax(axis=0)  # the score at that index
        over = np.where(np.arange(len(scores))[:, None] > place, pos, 0).sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, over / pos.sum(axis=0), np.nan)

    return value


def f1_of(tau: float) -> Metric:
    def value(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        over = scores > tau
        tp, fp, fn = pos[over].sum(axis=0), neg[over].sum(axis=0), pos[~over].sum(axis=0)
        return np.where(tp > 0, 2 * tp / np.maximum(1, 2 * tp + fp + fn), 0.0)

    return value


def bootstrap(df: DataFrame, keys: list[str], metrics: dict[str, Metric], repeats: int = fixed.BOOTSTRAP_N, alpha: float = 0.05, cells: int = 2_048, seed: int = 42) -> DataFrame:
    """(keys, metric, low, high): percentile intervals over ``repeats`` resamples of each group, with
    replacement and of its own size; values that aren't numbers are left out, NULL if all are.

    What is resampled are counts: of the distinct scores or, where scores are more, of ``cells`` about
    equal ranges of them, each with its smallest score. So a group is at most ``cells`` rows, whatever its
    size, and a resample is one multinomial draw.
    """
    steps = _steps(df, keys)
    cell = cell_of("score", cut_points(steps, "score", cells))
    rows = steps.groupBy(*keys, cell.alias("cell")).agg(F.min("score").alias("score"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    names = list(metrics)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("score")
        counts = np.concatenate([group["pos"].to_numpy(), group["neg"].to_numpy()]).astype(np.float64)
        rng = np.random.default_rng([seed, *group["pos"].tolist()[:8]])
        values: dict[str, list] = {m: [] for m in names}
        for at in range(0, repeats, 100):
            drawn = rng.multinomial(int(counts.sum()), counts / counts.sum(), min(100, repeats - at)).T
            pos, neg = drawn[: len(group)], drawn[len(group) :]
            for m in names:
                values[m].append(metrics[m](group["score"].to_numpy(), pos, neg))
        out = []
        for m in names:
            v = np.concatenate(values[m])
            v = v[np.isfinite(v)]
            out.append((m, *(np.quantile(v, [alpha / 2, 1 - alpha / 2]) if len(v) else (None, None))))
        made = pd.DataFrame(out, columns=["metric", "low", "high"])
        for k in keys:
            made[k] = group[k].iloc[0]
        return made[[*keys, "metric", "low", "high"]].astype({"low": "float64", "high": "float64"})

    kind = StructType([rows.schema[k] for k in keys]).add("metric", "string").add("low", "double").add("high", "double")
    return rows.groupBy(*keys).applyInPandas(run, kind)


def bootstrap_auc(df: DataFrame, keys: list[str], repeats: int = fixed.BOOTSTRAP_N) -> DataFrame:
    """(keys, low, high) of the AUC."""
    return bootstrap(df, keys, {"auc": auc_of}, repeats).drop("metric")


def _named(fpr: float) -> str:
    return f"{fpr:g}".replace(".", "_")


def detector_table(df: DataFrame, keys: list[str], fprs=fixed.TARGET_FPRS, at: float = 0.5, calibration: DataFrame | None = None) -> DataFrame:
    """(keys, n, auc, f1, tpr_at_fpr_<f> for each target): a row for each group, such as a detector.

    With ``calibration`` (keys, label, score; its benign rows count) also, for each target, tau_<f>, the
    threshold that it sets, and tpr_ext_tau_<f> and fpr_ext_tau_<f>, the rates at that threshold.
    """
    ranked = cut(_ranked(df, keys))
    over = lambda c: F.sum(F.when(F.col("score") > at, F.col(c)).otherwise(0))
    f1 = F.when(over("pos") == 0, 0.0).otherwise(2.0 * over("pos") / (over("pos") + over("neg") + F.sum("pos")))
    one = ranked.groupBy(*keys).agg((F.sum("pos") + F.sum("neg")).alias("n"), _auc().alias("auc"), f1.alias("f1"), *[_tau(f).alias(f"_own{i}") for i, f in enumerate(fprs)])
    columns = [F.when(F.first("q") > 0, _share_over("pos", F.col(f"_own{i}"))).alias(f"tpr_at_fpr_{_named(f)}") for i, f in enumerate(fprs)]
    if calibration is not None:
        ext = _ranked(calibration.where("label = 0"), keys).groupBy(*keys).agg(*[_tau(f).alias(f"_ext{i}") for i, f in enumerate(fprs)])
        one = join_keys(one, ext, keys, "left")
        for i, f in enumerate(fprs):
            known, tau = F.first(f"_ext{i}").isNotNull(), F.col(f"_ext{i}")
            columns += [F.first(tau).alias(f"tau_{_named(f)}"), F.when(known, _share_over("pos", tau)).alias(f"tpr_ext_tau_{_named(f)}"), F.when(known, _share_over("neg", tau)).alias(f"fpr_ext_tau_{_named(f)}")]
    rows = join_keys(ranked.select(*keys, "score", "pos", "neg", "q"), one, keys)
    return rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n", "auc", "f1")], *columns)


def detector_intervals(df: DataFrame, keys: list[str], fprs=fixed.TARGET_FPRS, repeats: int = fixed.BOOTSTRAP_N) -> DataFrame:
    """(keys, metric, low, high) for the AUC and the recall at each target."""
    return bootstrap(df, keys, {"auc": auc_of} | {f"tpr_at_fpr_{_named(f)}": tpr_of(f) for f in fprs}, repeats)


def calibrated(benign: DataFrame, keys: list[str], fprs=fixed.TARGET_FPRS) -> DataFrame:
    """(keys, tau_lo, tau_hi): the cascade's thresholds on benign scores, from the largest and the smallest
    target."""
    return _ranked(benign.where("label = 0"), keys).groupBy(*keys).agg(_tau(max(fprs)).alias("tau_lo"), _tau(min(fprs)).alias("tau_hi"))


def transfer(df: DataFrame, fprs=fixed.TARGET_FPRS) -> DataFrame:
    """(trained_on, tested_on, n, auc, tpr_at_fpr_<f>) of scores (trained_on, tested_on, label, score); pairs
    whose test has only one class are left out."""
    return detector_table(df, ["trained_on", "tested_on"], fprs).where("auc is not null").drop("f1")


def hard_cases(df: DataFrame, id_col: str, tau: float, each: int = 2) -> DataFrame:
    """(kind, id, score): the worst missed positives and false alarms; where there are none, the
    lowest positive and the highest benign score."""
    rows = df.where("label is not null and score is not null").select(F.col(id_col).alias("id"), "label", "score")

    def pick(kind: str, part: DataFrame, order, n: int) -> DataFrame:
        return part.orderBy(order, "id").limit(n).select(F.lit(kind).alias("kind"), "id", "score")

    pos, neg = rows.where("label = 1"), rows.where("label = 0")
    fn, fp = pos.where(F.col("score") <= tau), neg.where(F.col("score") > tau)
    missed = pick("false_negative", fn, F.asc("score"), each) if fn.limit(1).count() else pick("hardest_positive", pos, F.asc("score"), each)
    alarms = pick("false_positive", fp, F.desc("score"), each) if fp.limit(1).count() else pick("hardest_benign", neg, F.desc("score"), each)
    return missed.unionByName(alarms)
