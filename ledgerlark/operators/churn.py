"""Churn: training cutoffs, a boosted-tree model with calibration, scores and their risk."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numbers import risk_tier, rnd
from ledgerlark.functions.scale import dealt, materialise, with_running
from ledgerlark.operators.customers import FEATURES, feature_panel, features, parse_time
from ledgerlark.roles import Roles

MAX_CUTOFFS, MIN_HISTORY_DAYS, MIN_TRAIN_ROWS, MIN_VALID_ROWS = 6, 14, 40, 10
HIGH, MEDIUM = 0.70, 0.40


def history(df: DataFrame, roles: Roles) -> tuple[datetime, datetime]:
    row = parse_time(df, roles.time).agg(F.min("_dt").alias("lo"), F.max("_dt").alias("hi")).first()
    return row["lo"], row["hi"]


def horizon_for(first: datetime, last: datetime, wanted: int = 90) -> int:
    """The horizon the history allows: at most a third of it, at least a week."""
    return min(wanted, max(7, (last - first).days // 3))


def training_cutoffs(first: datetime, last: datetime, horizon: int) -> list[datetime]:
    """Newest first; each leaves a full outcome window and some history before it."""
    stride = timedelta(days=max(7, horizon // 2))
    newest = last - timedelta(days=horizon)
    points = (newest - stride * i for i in range(MAX_CUTOFFS))
    return [c for c in points if c >= first + timedelta(days=MIN_HISTORY_DAYS)]


def cutoffs_table(df: DataFrame, roles: Roles, wanted: int = 90) -> DataFrame:
    first, last = history(df, roles)
    horizon = horizon_for(first, last, wanted)
    rows = [(i, c, c + timedelta(days=horizon)) for i, c in enumerate(training_cutoffs(first, last, horizon))]
    return df.sparkSession.createDataFrame(rows, "position int, cutoff timestamp_ntz, horizon_end timestamp_ntz")


def heuristic_scores(df: DataFrame, roles: Roles, wanted: int = 90, *, span: tuple[datetime, datetime] | None = None, table: DataFrame | None = None) -> DataFrame:
    """Probability from recency over the horizon, when no model can be trained. *span*, *table*: the history and the features at its end, where known."""
    first, last = span or history(df, roles)
    return recency_scores(features(df, roles, last) if table is None else table, horizon_for(first, last, wanted))


def recency_scores(table: DataFrame, horizon: int) -> DataFrame:
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("recency_days") / F.lit(float(max(horizon, 1)))))
    return table.withColumn("churn_probability", F.round(p, 4))


def _classes(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col("churned") == 0).alias("n"), F.count_if(F.col("churned") == 1).alias("p")).first()
    return row["n"], row["p"]


def split_panel(df: DataFrame, roles: Roles, wanted: int = 90, seed: int = 42) -> tuple[DataFrame, DataFrame, str] | None:
    """Train and validation rows: the newest cutoff held out, or a stratified random
    quarter of it when history is short; None when no model can be trained."""
    first, last = history(df, roles)
    horizon = horizon_for(first, last, wanted)
    cutoffs = training_cutoffs(first, last, horizon)
    if not cutoffs:
        return None
    panel = materialise(feature_panel(df, roles, cutoffs, horizon))
    newest = panel.where(F.col("cutoff") == F.lit(cutoffs[0]).cast("timestamp_ntz"))
    older = panel.where(F.col("cutoff") < F.lit(cutoffs[0]).cast("timestamp_ntz"))
    (tn, tp), (vn, vp) = _classes(older), _classes(newest)
    if tn + tp >= MIN_TRAIN_ROWS and min(tn, tp) > 0 and vn + vp >= MIN_VALID_ROWS and min(vn, vp) > 0:
        return older, newest, "out_of_time"
    if vn + vp < MIN_TRAIN_ROWS or min(vn, vp) == 0:
        return None
    train = newest.sampleBy("churned", {0: 0.75, 1: 0.75}, seed)
    return train, newest.join(train.select("customer"), "customer", "left_anti"), "random_split"


def train(panel: DataFrame, *, iterations: int = 20, depth: int = 4, seed: int = 42):
    columns = [c for c in FEATURES if c in panel.columns]
    stages = [VectorAssembler(inputCols=columns, outputCol="features"),
              GBTClassifier(labelCol="churned", featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=0.1, seed=seed)]
    return Pipeline(stages=stages).fit(panel), columns


def with_probability(model, panel: DataFrame) -> DataFrame:
    """Probability as found (``score``, for ranking) and as reported (``p``, four decimals), and the raw margin."""
    return model.transform(panel).withColumn("score", vector_to_array("probability")[1]).withColumn("p", F.round("score", 4)).withColumn(
        "margin", vector_to_array("rawPrediction")[1])


def calibrate(scored: DataFrame):
    """Sigmoid on the raw margin, when both classes have at least 15 rows."""
    if min(_classes(scored)) < 15:
        return None
    return Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="margin_vector"),
                            LogisticRegression(featuresCol="margin_vector", labelCol="churned", probabilityCol="calibrated",
                                               rawPredictionCol="raw_calibrated", predictionCol="calibrated_label")]).fit(
        scored.select("margin", "churned"))


def auc(scored: DataFrame, groups: list[str], score: str = "p") -> DataFrame:
    """Area under the ROC curve per group, from counts per score in one global order.

    The order runs through all groups, so a group's own count starts at its smallest running sum.
    """
    counts = scored.groupBy(*groups, score).agg(F.sum("churned").alias("pos"), F.sum(1 - F.col("churned")).alias("neg"))
    ranked = with_running(counts, [*map(F.col, groups), F.col(score)], sums={"upto": F.col("neg")})
    area = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)) - F.sum("pos") * F.min(F.col("upto") - F.col("neg"))
    return ranked.groupBy(*groups).agg((area / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def metrics(scored: DataFrame, validation: str) -> DataFrame:
    """AUC, accuracy, precision, recall, F1 and the confusion counts at 0.5."""
    hit, truth = F.col("p") >= 0.5, F.col("churned") == 1
    counts = scored.agg(
        F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"),
        F.count_if(~hit & ~truth).alias("tn"))
    area = auc(scored.withColumn("g", F.lit(1)), ["g"], "score").select("auc").scalar()
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return counts.select(
        F.lit(validation).alias("validation"), rnd(area, 3).alias("auc"), rnd((F.col("tp") + F.col("tn")) / n, 3).alias("accuracy"),
        rnd(precision, 3).alias("precision"), rnd(recall, 3).alias("recall"), rnd(f1, 3).alias("f1"), "tp", "fp", "fn", "tn")


def permutation_importance(model, valid: DataFrame, columns: list[str], repeats: int = 5) -> DataFrame:
    """Drop of the AUC when one feature is taken from another, randomly paired row.

    Rows are put into one random order, and in every repeat a row is paired with the one a
    fixed distance further on (round the end), so all shuffles are one sort and one join
    whatever the number of rows; all features of all repeats are scored in one pass, by
    tasks of a bounded number of scored rows.
    """
    base = valid.select("customer", "cutoff", "churned", *columns)
    ordered = with_running(base, [F.xxhash64(F.lit("order"), "customer", "cutoff"), F.col("customer"), F.col("cutoff")], rank="rn", total_rows="n")
    n, repeat = F.col("n"), F.col("repeat")
    moved = ordered.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn(
        "rn", (F.col("rn") - 1 + F.floor(n * repeat / (repeats + 1))) % n + 1)
    rows = ordered.count() * repeats * len(columns)  # a pair becomes a row for each feature in the task that made it
    others = dealt(ordered.select("rn", *[F.col(c).alias(f"o_{c}") for c in columns]), rows, "rn")
    paired = dealt(moved, rows, "rn").join(others, "rn")
    swapped = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[(F.col(f"o_{c}") if c == f else F.col(c)).alias(c) for c in columns]) for f in columns]))
    everything = ordered.select(F.lit(0).alias("repeat"), F.lit("").alias("feature"), "churned", *columns).unionByName(
        paired.select("repeat", "churned", swapped.alias("v")).select("repeat", "v.feature", "churned", *[F.col(f"v.{c}").alias(c) for c in columns]))
    areas = auc(with_probability(model, everything), ["repeat", "feature"], "score")
    whole = areas.where("feature = ''").select("auc").scalar()
    drops = areas.where("feature <> ''").withColumn("drop", whole - F.col("auc"))
    return drops.groupBy("feature").agg(F.round(F.greatest(F.avg("drop"), F.lit(0.0)), 4).alias("importance"))


def score_customers(df: DataFrame, roles: Roles, wanted: int = 90) -> DataFrame:
    """All customers as of the last date: calibrated model, or the recency fallback."""
    first, last = history(df, roles)
    live = features(df, roles, last)
    split = split_panel(df, roles, wanted)
    if split is None:
        return recency_scores(live, horizon_for(first, last, wanted))
    older, newest, _ = split
    model, _ = train(older)
    scored = with_probability(model, live.withColumn("churned", F.lit(0)))
    sigmoid = calibrate(with_probability(model, newest))
    if sigmoid is not None:
        p = F.round(vector_to_array("calibrated")[1], 4)
        return sigmoid.transform(scored).select(*live.columns, p.alias("churn_probability"))
    return scored.select(*live.columns, F.col("p").alias("churn_probability"))


def risk_summary(scores: DataFrame) -> DataFrame:
    """Customers per tier, spend of likely churners, expected loss."""
    p = F.col("churn_probability")
    return scores.agg(
        F.count(F.lit(1)).alias("customers_scored"), F.count_if(p >= HIGH).alias("high"),
        F.count_if((p >= MEDIUM) & (p < HIGH)).alias("medium"), F.count_if(p < MEDIUM).alias("low"),
        rnd(F.coalesce(F.sum(F.when(p >= 0.5, F.col("monetary"))), F.lit(0.0))).alias("revenue_at_risk"),
        rnd(F.sum(p * F.col("monetary"))).alias("expected_revenue_at_risk"))


def at_risk(scores: DataFrame, n: int = 200) -> DataFrame:
    """The customers to look at first: by expected loss, then probability."""
    loss = F.col("churn_probability") * F.col("monetary")
    return scores.withColumn("loss", loss).orderBy(F.desc("loss"), F.desc("churn_probability"), "customer").limit(n).select(
        "customer", "churn_probability", risk_tier(F.col("churn_probability")).alias("risk_tier"), "recency_days", "frequency",
        rnd(F.col("monetary")).alias("monetary"), rnd(F.col("loss")).alias("expected_loss"))


def risk_by_segment(scores: DataFrame, segments: DataFrame) -> DataFrame:
    joined = scores.select("customer", "churn_probability").join(segments.select("customer", "segment"), "customer")
    high = F.count_if(F.col("churn_probability") >= HIGH)
    return joined.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers_scored"), rnd(F.avg("churn_probability"), 3).alias("avg_churn_probability"),
        high.alias("high_risk_count"), rnd(high / F.count(F.lit(1)) * 100, 1).alias("high_risk_pct"))


def target_lists(scores: DataFrame) -> DataFrame:
    """Customers to address, by tier; the caller orders within a tier."""
    p = F.col("churn_probability")
    return scores.where(p >= MEDIUM).select(F.when(p >= HIGH, "high_risk").otherwise("medium_risk").alias("list"), "customer", "churn_probability")
