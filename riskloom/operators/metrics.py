"""Ranking, calibration and split operators that never sort the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import scan, selection
from riskloom.functions.storage import saved
from riskloom.sources.schema import SCHEMES

TRAIN_SHARE, VALID_SHARE = 0.60, 0.15
FIRST_TRAIN, FOLD_VALID, FOLDS = 0.40, 0.10, 4


def _part(n: Column, share) -> Column:
    return F.floor(n * share)


def positions(df: DataFrame, at: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """One row with the order values of the rows at given indexes (expressions of the row count
    ``n``); null past the end. Nothing is ranked but the ties of those rows."""
    order = order or ["us", "tx_id"]
    spark = df.sparkSession
    d = selection.narrow(df, *order)

    def ranks(n: int) -> dict[str, int]:
        return spark.range(1).select(F.lit(n).alias("n")).select(*[pos.cast("long").alias(name) for name, pos in at.items()]).first().asDict()

    _, rows = selection.rows_at(d, order, ranks)
    schema = T.StructType([T.StructField(name, T.StructType([d.schema[c] for c in order])) for name in at])
    return spark.createDataFrame([tuple(rows[name] for name in at)], schema)


def _before(at: str, order: list[str]) -> Column:
    return F.coalesce(F.struct(*order) < F.col(at), F.lit(True))


def split_starts() -> dict[str, Column]:
    n = F.col("n")
    return {"_valid_at": _part(n, TRAIN_SHARE), "_test_at": _part(n, TRAIN_SHARE + VALID_SHARE)}


def time_split(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add ``split``: first 60 % train, next 15 % valid, rest test. Rows are compared with the two
    boundary rows and do not move."""
    order = order or ["us", "tx_id"]
    d = _attach(df, positions(df, split_starts(), order))
    return d.withColumn("split", F.when(_before("_valid_at", order), "train").when(_before("_test_at", order), "valid")
                        .otherwise("test")).drop("_valid_at", "_test_at")


def _attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table next to every row, by a join on a constant."""
    return df.withColumn("_all", F.lit(0)).join(F.broadcast(one_row.withColumn("_all", F.lit(0))), "_all").drop("_all")


def fold_table(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Row ranges of the walk-forward folds: growing train, moving valid and test."""
    share = (1.0 - FIRST_TRAIN - FOLD_VALID) / folds
    g = df.agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    train = F.lit(FIRST_TRAIN) + F.lit(share) * F.col("k")
    valid = train + FOLD_VALID
    test = F.least(valid + share, F.lit(1.0))
    n = F.col("n")
    return g.select((F.col("k") + 1).alias("fold"), _part(n, train).alias("train_end"),
                    _part(n, valid).alias("valid_end"), _part(n, test).alias("test_end"))


def fold_ranges(n: int, folds: int = FOLDS) -> list[tuple[int, int, int]]:
    share = (1.0 - FIRST_TRAIN - FOLD_VALID) / folds
    out = []
    for k in range(folds):
        train = FIRST_TRAIN + share * k
        valid = train + FOLD_VALID
        out.append((int(n * train), int(n * valid), int(n * min(valid + share, 1.0))))
    return out


def test_fold(df: DataFrame, folds: int = FOLDS, order: list[str] | None = None) -> DataFrame:
    """Rows that are tested in some fold, with their ``fold``. Test ranges follow each other, so a
    row has at most one; it is found by comparing with the boundary rows."""
    order = order or ["us", "tx_id"]
    share = (1.0 - FIRST_TRAIN - FOLD_VALID) / folds
    at = {f"_f{k}": _part(F.col("n"), FIRST_TRAIN + share * k + FOLD_VALID) for k in range(folds)}
    d = _attach(df, positions(df, at, order))
    fold = sum(((~_before(name, order)).cast("int") for name in at), F.lit(0))
    return d.withColumn("fold", fold).where(F.col("fold") >= 1).drop(*at)


def score_curve(df: DataFrame, score: str, label: str = "is_fraud", keys: list[str] | None = None) -> DataFrame:
    """One row per distinct score with positives and negatives at it (``pos``, ``neg``) and above it."""
    d = df if keys else df.withColumn("_all", F.lit(0))
    keys = keys or ["_all"]
    # scores may come from a model, so they are computed once
    g = saved(d.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(1 - F.col(label).cast("long")).alias("neg"))).withColumn("_down", -F.col("score"))
    return scan.running(g, keys, ["_down"], sums={"pos_above": "pos", "neg_above": "neg"}).drop("_down")


def _measure(curve: DataFrame, keys: list[str] | None, *aggs: Column) -> DataFrame:
    out = curve.groupBy(*(keys or ["_all"])).agg(*aggs)
    return out if keys else out.drop("_all")


# measures over the rows of a score curve

def _tp() -> Column:
    return F.col("pos_above") + F.col("pos")


def _precision() -> Column:
    return _tp() / (_tp() + F.col("neg_above") + F.col("neg"))


def _auc() -> Column:
    area = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    return F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def _ap() -> Column:
    return F.try_divide(F.sum(F.col("pos") * _precision()), F.sum("pos").cast("double"))


def _recall(target: float) -> Column:
    reached = F.max(F.when(_precision() >= target, _tp()))
    return F.coalesce(F.try_divide(reached, F.sum("pos")), F.lit(0.0))


def roc_auc(df: DataFrame, score: str = "p_fraud", label: str = "is_fraud", keys=None) -> DataFrame:
    return _measure(score_curve(df, score, label, keys), keys, _auc().alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "p_fraud", label: str = "is_fraud", keys=None) -> DataFrame:
    return _measure(score_curve(df, score, label, keys), keys, _ap().alias("average_precision"))


def ranking_metrics(df: DataFrame, score: str = "p_fraud", label: str = "is_fraud", keys=None) -> DataFrame:
    """Average precision (``pr_auc``), ROC-AUC and recall at precision 0.90 from one score curve."""
    return _measure(score_curve(df, score, label, keys), keys, _ap().alias("pr_auc"), _auc().alias("roc_auc"),
                    _recall(0.90).alias("recall_at_precision90"))


def recall_at_precision(df: DataFrame, targets: list[float], score: str = "p_fraud",
                        label: str = "is_fraud", keys=None) -> DataFrame:
    """Largest recall that keeps the precision, with its threshold; 0 and 1 if out of reach."""
    best = [F.max(F.when(_precision() >= t, F.struct(_tp().alias("tp"), (-F.col("score")).alias("s")))).alias(f"_t{i}")
            for i, t in enumerate(targets)]
    g = _measure(score_curve(df, score, label, keys), keys, F.sum("pos").alias("_p"), *best)
    rows = F.explode(F.array(*[F.struct(
        F.lit(t).alias("target"),
        F.coalesce(F.try_divide(F.col(f"_t{i}.tp"), F.col("_p")), F.lit(0.0)).alias("recall"),
        F.coalesce(-F.col(f"_t{i}.s"), F.lit(1.0)).alias("threshold")) for i, t in enumerate(targets)]))
    return g.select(*(keys or []), rows.alias("r")).select(*(keys or []), "r.*")


def brier(score: str = "p_fraud", label: str = "is_fraud") -> Column:
    d = F.col(score) - F.col(label).cast("double")
    return F.avg(d * d)


def _budget_rows(rows: int, budget: float) -> int:
    return max(1, round(rows * budget))  # halves go to the even number


def recalls_of_scores(df: DataFrame, scores: dict[str, Column], masks: dict[str, Column], budget: float = 0.02, tie: str = "tx_id") -> DataFrame:
    """Per score and mask: ``recall``, the share of the mask's rows among the top ``budget`` of all rows by that score, and ``n``, its rows.

    All scores are columns of one stored table. The score of each one's last row within the budget is selected in the same passes, then the place of
    the cut among its ties, and one more pass counts all. The tie column is a number. Rows without a score count as rows but are never
    among the top."""
    down = {name: (-c).alias(f"s{i}") for i, (name, c) in enumerate(scores.items())}
    flags = [F.coalesce(m, F.lit(False)).alias(f"m{i}") for i, m in enumerate(masks.values())]
    d = selection.narrow(df, *down.values(), F.col(tie).alias("_tie"), *flags)
    last = _budget_rows(d.count(), budget) - 1
    columns = {name: F.col(f"s{i}") for i, name in enumerate(scores)}
    cuts = selection.values_at(d, columns, lambda _, n: [min(last, n - 1)])
    at = {name: next(iter(found.values())) for name, (n, found) in cuts.items() if n}
    left = {name: min(last, cuts[name][0] - 1) - f.below for name, f in at.items()}
    tied = {name: F.when(columns[name] == f.value, F.col("_tie")) for name, f in at.items()}
    ends = selection.values_at(d, tied, lambda name, _: [left[name]]) if tied else {}

    def top(name: str) -> Column:
        if name not in at:
            return F.lit(False)
        c, (found,) = columns[name], ends[name][1].values()
        inside = (c < at[name].value) | ((c == at[name].value) & (F.col("_tie") <= found.value))
        return F.coalesce(inside & ~F.isnan(c), F.lit(False))

    counts = [F.struct(F.lit(score).alias("score"), F.lit(name).alias("name"), F.avg(F.when(F.col(f"m{i}"), top(score).cast("double"))).alias("recall"),
                       F.count_if(f"m{i}").alias("n")) for score in scores for i, name in enumerate(masks)]
    return d.agg(F.array(*counts).alias("_all")).select(F.inline("_all"))


def recalls_at_budget(df: DataFrame, masks: dict[str, Column], score: str = "p_fraud", budget: float = 0.02,
                      tie: str = "tx_id") -> DataFrame:
    """Per mask (``name``): ``recall``, the share of its rows among the top ``budget`` of all rows by score, and ``n``, its rows.

    The score of the last row of the budget is selected, only its ties are ranked, and one pass counts all masks. The tie column may be a
    text. Rows without a score count as rows but are never among the top."""
    order = ["_down", "_tie"]
    flags = [F.coalesce(m, F.lit(False)).alias(f"m{i}") for i, m in enumerate(masks.values())]
    d = selection.narrow(df, (-F.col(score)).alias("_down"), F.col(tie).alias("_tie"), *flags)
    last = _budget_rows(d.count(), budget) - 1
    n, found = selection.rows_at(d, order, lambda n: {"last": max(0, min(last, n - 1))})
    top = F.coalesce(selection.at_or_before(order, found["last"]), F.lit(False)) if n else F.lit(False)
    top = top & F.col("_down").isNotNull() & ~F.isnan("_down")
    long = d.select(top.alias("top"), F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"m{i}").alias("hit")) for i, name in enumerate(masks)])).alias("m"))
    return long.groupBy("m.name").agg(F.avg(F.when(F.col("m.hit"), F.col("top").cast("double"))).alias("recall"), F.count_if("m.hit").alias("n"))


def recall_at_budget(df: DataFrame, mask: Column, score: str = "p_fraud", budget: float = 0.02,
                     tie: str = "tx_id") -> DataFrame:
    """Share of the masked rows among the top ``budget`` of all rows by score; one row."""
    d = recalls_at_budget(df, {"all": mask}, score, budget, tie)
    return d.agg(F.max("recall").alias("recall"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def reliability_curve(df: DataFrame, score: str = "p_fraud", label: str = "is_fraud", bins: int = 10,
                      min_rows: int = 20) -> DataFrame:
    """Predicted and actual rate in bins whose edges are 0 and the upper-decile quantiles."""
    step = 0.1 / (bins - 1)
    probs = [0.9 + step * i for i in range(bins - 1)] + [1.0]
    d = selection.narrow(df, F.col(score).alias("p"), F.col(label).cast("double").alias("y"))
    q = selection.quantiles_of(d, {"p": F.col("p")}, probs)["p"]
    edges = F.sort_array(F.array_distinct(F.array(F.lit(0.0), *[F.round(F.lit(x), 6) for x in q])))
    d = d.withColumn("edges", edges)
    last = F.size("edges") - 1
    # the last bin is open upwards, so rounding its edge down loses no row
    bin_no = F.least(F.size(F.filter("edges", lambda e: e <= F.col("p"))), last)
    g = d.where(bin_no >= 1).groupBy(bin_no.alias("bin"), "edges").agg(
        F.count("*").alias("count"), F.avg("p").alias("predicted"), F.avg("y").alias("actual"))
    return g.where(F.col("count") >= min_rows).select(
        F.get("edges", F.col("bin") - 1).alias("p_lo"), F.get("edges", F.col("bin")).alias("p_hi"),
        "count", "predicted", "actual")


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, smallest, largest and number of measurements that are numbers."""
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return d.groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("min"),
                                F.max(value).alias("max"), F.count("*").alias("n"))


def fold_metrics(scored: DataFrame, score: str = "p_fraud") -> DataFrame:
    """Per fold: sizes, ROC-AUC, average precision, recall at precision 0.90. ``scored`` has the
    test rows of every fold with their ``fold``."""
    size = scored.groupBy("fold").agg(F.count("*").alias("rows_test"),
                                      F.sum(F.col("is_fraud").cast("long")).alias("fraud_in_test"))
    return size.join(ranking_metrics(scored, score, keys=["fold"]), "fold")


def fold_scheme_share(scored: DataFrame, score: str = "p_fraud", min_rows: int = 5) -> DataFrame:
    """Per fold and scheme: how much of the fraud is scored above one half."""
    return (scored.where((F.col("is_fraud") == 1) & F.col("fraud_type").isin(SCHEMES))
            .groupBy("fold", "fraud_type")
            .agg(F.count("*").alias("n"), F.avg((F.col(score) > 0.5).cast("double")).alias("share_above_half"))
            .where(F.col("n") >= min_rows))


def fold_summary(metrics: DataFrame) -> DataFrame:
    long = metrics.unpivot(["fold"], ["pr_auc", "roc_auc", "recall_at_precision90"], "metric", "value")
    return spread(long, ["metric"], "value")


def type_accuracy(df: DataFrame, predicted: str = "predicted_kind") -> DataFrame:
    """Share of frauds with the right scheme: one row per scheme and one for all."""
    hit = F.avg((F.col(predicted) == F.col("fraud_type")).cast("double"))
    d = df.where(F.col("is_fraud") == 1)
    return (d.rollup("fraud_type").agg(F.count("*").alias("n"), hit.alias("accuracy"))
            .select(F.coalesce("fraud_type", F.lit("all")).alias("fraud_type"), "n", "accuracy"))
