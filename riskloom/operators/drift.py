"""Has the stream moved (PSI per feature) and do probabilities still hold (weekly calibration)?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import selection
from riskloom.operators import metrics
from riskloom.sources.schema import ACCUMULATING, FEATURES

# ---- fixed values: limits of the control gate ---------------------------------------------
PSI_MODERATE, PSI_SIGNIFICANT = 0.10, 0.25
CALIBRATION_GAP = 0.006
MIN_WEEK_ROWS = 200
SHARE_FLOOR = 1e-4


def adjacent_windows(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The test slice (``side`` = current) and the equally long window before it (reference)."""
    order = order or ["us", "tx_id"]
    start = F.floor(F.col("n") * (metrics.TRAIN_SHARE + metrics.VALID_SHARE))
    at = {"_current_at": start, "_reference_at": F.greatest(start - (F.col("n") - start), F.lit(0))}
    d = metrics._attach(df, metrics.positions(df, at, order))
    return d.withColumn("side", F.when(~metrics._before("_current_at", order), "current")
                        .when(~metrics._before("_reference_at", order), "reference")
                        ).where(F.col("side").isNotNull()).drop(*at)


def verdict(psi: Column) -> Column:
    return (F.when(psi >= PSI_SIGNIFICANT, "significant").when(psi >= PSI_MODERATE, "moderate")
            .otherwise("stable"))


def psi(df: DataFrame, features: list[str] = FEATURES, bins: int = 10) -> DataFrame:
    """PSI of each feature between rows with side = reference and side = current. Edges are the distinct quantiles of
    the reference; values that are null or NaN do not count.

    The features are stored once. Their quantiles are selected by histograms of all features at once, and one more pass counts
    both sides per bin: no row is unpivoted or shuffled. What comes to the driver is bounded by features and bins."""
    d = selection.narrow(df, "side", *[F.col(f).cast("double").alias(f) for f in features])
    reference = {f: F.when(F.col("side") == "reference", F.col(f)) for f in features}
    edges = {f: list(dict.fromkeys(q)) for f, q in selection.quantiles_of(d, reference, [i / bins for i in range(bins + 1)]).items()}
    inner = {f: e[1:-1] if len(e) >= 3 else [] for f, e in edges.items()}
    usable = F.col("feature").isin([f for f, e in edges.items() if len(e) >= 3])
    counts = _bin_counts(d, inner)
    total = counts.groupBy("feature").agg(F.sum("e").alias("_e"), F.sum("a").alias("_a"))
    g = counts.join(F.broadcast(total), "feature")  # one row per feature
    es = F.greatest(F.try_divide(F.col("e"), F.col("_e")), F.lit(SHARE_FLOOR))
    as_ = F.greatest(F.try_divide(F.col("a"), F.col("_a")), F.lit(SHARE_FLOOR))
    counted = usable & (F.col("_e") > 0) & (F.col("_a") > 0)
    g = g.groupBy("feature").agg(F.sum(F.when(counted, (as_ - es) * F.log(as_ / es)).otherwise(F.lit(0.0))).alias("psi"))
    return g.withColumns({"verdict": verdict(F.col("psi")), "accumulating": F.col("feature").isin(ACCUMULATING)})


def _bin_counts(d: DataFrame, inner: dict[str, list[float]]) -> DataFrame:
    """feature, bin, e, a: reference and current rows per bin, counted within the tasks before the shuffle."""
    names = list(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {f: np.zeros((2, len(x) + 1), np.int64) for f, x in inner.items()}
        for b in batches:
            side = b.column("side").to_numpy(zero_copy_only=False)
            for f, x in inner.items():
                v = b.column(f).to_numpy(zero_copy_only=False)
                for k, name in enumerate(("reference", "current")):
                    own = v[side == name]
                    counts[f][k] += np.bincount(np.searchsorted(x, own[~np.isnan(own)], side="right"), minlength=len(x) + 1)
        for f, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * c.shape[1]), pa.array(np.arange(c.shape[1])), pa.array(c[0]), pa.array(c[1])],
                                             names=["feature", "bin", "e", "a"])

    parts = d.select("side", *names).mapInArrow(run, "feature string, bin long, e long, a long")
    return parts.groupBy("feature", "bin").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))


def calibration_by_week(scored: DataFrame, score: str = "p_fraud", min_rows: int = MIN_WEEK_ROWS) -> DataFrame:
    """Predicted against actual fraud rate per week ending on Sunday."""
    week = F.next_day(F.date_sub(F.to_date("timestamp"), 1), "SU")
    g = scored.groupBy(week.alias("period")).agg(
        F.count("*").alias("count"), F.avg(score).alias("predicted"), F.avg(F.col("is_fraud").cast("double")).alias("actual"))
    return g.where(F.col("count") >= min_rows).select(
        F.col("period").cast("string").alias("period"), "count", "predicted", "actual",
        (F.col("predicted") - F.col("actual")).alias("gap"))


def gate(psi_rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """One row: may the model be trusted further? Growing features do not count."""
    bad = F.when(~F.col("accumulating") & (F.col("verdict") == "significant"),
                 F.struct((-F.col("psi")).alias("k"), F.col("feature").alias("f")))
    # at most one entry per feature
    shift = psi_rows.agg(F.sort_array(F.collect_list(bad)).alias("s")).select(
        F.lit(0).alias("_all"), F.size("s").alias("n_shifted"),
        F.array_join(F.transform(F.slice("s", 1, 5), lambda x: x["f"]), ", ").alias("shifted"))
    worst = calibration.agg(F.coalesce(F.max(F.abs("gap")), F.lit(0.0)).alias("worst_gap")).withColumn("_all", F.lit(0))
    d = shift.join(worst, "_all").drop("_all")
    ok = (F.col("n_shifted") == 0) & (F.col("worst_gap") <= CALIBRATION_GAP)
    return d.select(ok.alias("ok"), F.when(ok, "ok").otherwise("retrain").alias("verdict"), "n_shifted", "shifted",
                    (F.col("worst_gap") > CALIBRATION_GAP).alias("calibration_broken"), "worst_gap",
                    F.lit(CALIBRATION_GAP).alias("gap_threshold"))


# ---- fixed values: wording of the gate's reasons -------------------------------------------
GATE_TEXT = {
    "data_shift": {
        "ru": "Значимо сдвинулись признаки: {v}. Модель видит не тот поток, на котором училась.",
        "kk": "Белгілер елеулі жылжыды: {v}.",
        "en": "Significant shift in: {v}. The model is seeing a different stream than it learned on.",
    },
    "calibration": {
        "ru": "Предсказанная доля фрода расходится с фактической на {v}. "
              "Стоимостная модель считает потери по неверной вероятности.",
        "kk": "Болжанған және нақты алаяқтық үлесі {v} айырмашылықта.",
        "en": "Predicted fraud share diverges from actual by {v}. "
              "The cost model is pricing losses off a wrong probability.",
    },
}


def gate_reasons(gate_row: DataFrame) -> DataFrame:
    """The gate's reasons in three languages, one row per reason."""
    shown = {"data_shift": F.col("shifted"), "calibration": F.format_string("%.4f", F.col("worst_gap"))}
    when = {"data_shift": F.col("n_shifted") > 0, "calibration": F.col("calibration_broken")}
    rows = [F.when(when[k], F.struct(F.lit(k).alias("kind"), *[
        F.replace(F.lit(t), F.lit("{v}"), shown[k]).alias(lang) for lang, t in texts.items()]))
        for k, texts in GATE_TEXT.items()]
    return gate_row.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")
