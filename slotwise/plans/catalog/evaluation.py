"""Queries that evaluate scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.columns import binarize, sigmoid
from slotwise.operators import evaluate as v
from slotwise.operators import model as m
from slotwise.operators.series import neighbour_features
from slotwise.plans import inputs as src
from slotwise.plans.catalog.learning import (
    FILLED,
    FIT_NEAR,
    LONGEST,
    NEAR,
    NEIGHBOURS,
    STEPS,
    _fit_near,
    _fitted,
    _scored_sql,
    labelled_of,
    longest_train,
)
from slotwise.plans.catalog.registry import SCORES, query, rounded
from slotwise.plans.catalog.series import MEASURES
from slotwise.plans.learning import evaluate
from slotwise.session import stored

COUNTS = """counts AS (
  SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY 1),
run AS (SELECT p, pos, neg, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
    (SELECT sum(pos) FROM counts) AS np, (SELECT sum(neg) FROM counts) AS nn
  FROM counts WINDOW w AS (ORDER BY p DESC))"""

CURVE = f"""{SCORES}, {COUNTS}, curve AS (
  SELECT p AS threshold, tps::BIGINT AS tps, fps::BIGINT AS fps, tps::DOUBLE / np AS tpr,
    fps::DOUBLE / nn AS fpr, tps::HUGEINT * nn - fps::HUGEINT * np AS d FROM run
  UNION ALL SELECT max(p) + 1, 0, 0, 0, 0, 0 FROM counts)"""

ROC_AUC = "sum(neg::DOUBLE * (tps - pos + pos::DOUBLE / 2)) / (max(np)::DOUBLE * max(nn))"
PR_POINTS = """points AS (
  SELECT p, tps::DOUBLE / (tps + fps) AS precision, tps::DOUBLE / np AS recall FROM run
  UNION ALL SELECT NULL, 1.0, 0.0)"""
PR_AUC = """(SELECT sum((recall - r0) * (precision + p0) / 2) FROM (
    SELECT recall, precision, lag(recall) OVER w AS r0, lag(precision) OVER w AS p0 FROM points
    WINDOW w AS (ORDER BY p DESC NULLS FIRST)))"""


@query(
    "roc_curve",
    f"""WITH {CURVE} SELECT round(threshold, 6) AS threshold, tps, fps, round(tpr, 6) AS tpr,
      round(fpr, 6) AS fpr FROM curve""",
)
def roc_curve(spark, sf):
    return rounded(v.roc_curve(src.scores(spark, sf), "y", "p"), "threshold", "tpr", "fpr")


@query(
    "roc_auc", f"WITH {SCORES}, {COUNTS} SELECT round({ROC_AUC}, 8) AS roc_auc FROM run"
)
def roc_auc(spark, sf):
    return rounded(v.roc_auc(src.scores(spark, sf), "y", "p"), "roc_auc", digits=8)


@query(
    "roc_auc_by_group",
    f"""WITH {SCORES}, r AS (
      SELECT kind, y, (rank() OVER w + (count(*) OVER (PARTITION BY kind, p) - 1) / 2.0::DOUBLE)
        AS mid FROM scores WINDOW w AS (PARTITION BY kind ORDER BY p))
    SELECT kind, round((sum(mid) FILTER (WHERE y = 1)
        - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * sum(1 - y)), 8) AS roc_auc
    FROM r GROUP BY 1""",
)
def roc_auc_by_group(spark, sf):
    return rounded(v.roc_auc(src.scores(spark, sf), "y", "p", by=["kind"]), "roc_auc", digits=8)


@query(
    "pr_curve",
    f"""WITH {SCORES}, {COUNTS}, {PR_POINTS} SELECT round(p, 6) AS threshold,
      round(precision, 6) AS precision, round(recall, 6) AS recall FROM points""",
)
def pr_curve(spark, sf):
    out = v.pr_curve(src.scores(spark, sf), "y", "p")
    return rounded(out, "threshold", "precision", "recall")


@query(
    "pr_auc",
    f"WITH {SCORES}, {COUNTS}, {PR_POINTS} SELECT round({PR_AUC}, 8) AS pr_auc",
)
def pr_auc(spark, sf):
    return rounded(v.pr_auc(src.scores(spark, sf), "y", "p"), "pr_auc", digits=8)


@query(
    "mean_absolute_error",
    f"WITH {SCORES} SELECT kind, round(avg(abs(p - y)), 8) AS mae FROM scores GROUP BY 1",
)
def mean_absolute_error(spark, sf):
    out = v.mean_absolute_error(src.scores(spark, sf), "y", "p", by=["kind"])
    return rounded(out, "mae", digits=8)


@query(
    "sigmoid_threshold",
    """SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 8) AS p,
      (1 / (1 + exp(-(value - 50) / 10)) > 0.5)::INT AS pred FROM events""",
)
def sigmoid_threshold(spark, sf):
    logit = (F.col("value") - 50) / F.lit(10.0)
    rows = src.events(spark, sf).select("event_id", sigmoid(logit).alias("p"))
    return rounded(rows.withColumn("pred", binarize("p", 0.5)), "p", digits=8)


CONFUSION = f"""{SCORES}, cm AS (
  SELECT count(*) FILTER (WHERE y = 1 AND p > 0.5) AS tp,
    count(*) FILTER (WHERE y = 0 AND p > 0.5) AS fp,
    count(*) FILTER (WHERE y = 1 AND p <= 0.5) AS fn,
    count(*) FILTER (WHERE y = 0 AND p <= 0.5) AS tn FROM scores)"""
RATES = """tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 8) AS accuracy,
      round(tp::DOUBLE / (tp + fn), 8) AS recall,
      round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp)
        * (tn + fn)), 8) AS mcc,
      round(tp::DOUBLE / (tp + fp), 8) AS precision,
      round(2 * tp::DOUBLE / (2 * tp + fp + fn), 8) AS f1,
      round(fp::DOUBLE / (fp + tn), 8) AS fpr"""
RATE_NAMES = ["accuracy", "recall", "mcc", "precision", "f1", "fpr"]


@query(
    "f1_at",
    f"WITH {CONFUSION} SELECT round(2 * tp::DOUBLE / (2 * tp + fp + fn), 8) AS f1 FROM cm",
)
def f1_at(spark, sf):
    return rounded(v.f1_at(src.scores(spark, sf), "y", "p", 0.5), "f1", digits=8)


@query("classification_report", f"WITH {CONFUSION} SELECT {RATES} FROM cm")
def classification_report(spark, sf):
    rows = src.scores(spark, sf).withColumn("pred", binarize("p", 0.5))
    return rounded(v.classification_report(rows, "y", "pred"), *RATE_NAMES, digits=8)


BEST = "(SELECT threshold, tpr, fpr FROM curve ORDER BY d DESC, threshold DESC LIMIT 1)"


@query(
    "best_threshold",
    f"""WITH {CURVE} SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr,
      round(fpr, 6) AS fpr FROM {BEST}""",
)
def best_threshold(spark, sf):
    out = v.best_threshold(src.scores(spark, sf), "y", "p")
    return rounded(out, "threshold", "tpr", "fpr")


@query(
    "evaluate",
    f"""WITH {CONFUSION.replace(SCORES, CURVE)}, {PR_POINTS}
    SELECT {RATES}, (SELECT round({ROC_AUC}, 8) FROM run) AS roc_auc,
      round({PR_AUC}, 8) AS pr_auc, round(b.threshold, 8) AS best_threshold,
      round(b.tpr, 8) AS best_tpr, round(b.fpr, 8) AS best_fpr
    FROM cm, {BEST} b""",
)
def evaluated(spark, sf):
    out = evaluate(src.scores(spark, sf))
    names = [*RATE_NAMES, "roc_auc", "pr_auc", "best_threshold", "best_tpr", "best_fpr"]
    return rounded(out, *names, digits=8)


FITTED = f"""{STEPS}, {NEIGHBOURS}, {FIT_NEAR}, scores AS (
  SELECT id, slot AS time, {_scored_sql('near_fit', NEAR)} AS p, stage AS y FROM wide WHERE split <> 'train')"""


@query(
    "fit_score_evaluate",
    f"""WITH RECURSIVE {CONFUSION.replace(SCORES, CURVE).replace(SCORES, FITTED)}, {PR_POINTS}
    SELECT * REPLACE (CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN 0 ELSE mcc END AS mcc, CASE WHEN tp + fp = 0 THEN 0 ELSE precision END AS precision) FROM (
    SELECT {RATES}, (SELECT round({ROC_AUC}, 8) FROM run) AS roc_auc,
      round({PR_AUC}, 8) AS pr_auc, round(b.threshold, 8) AS best_threshold,
      round(b.tpr, 8) AS best_tpr, round(b.fpr, 8) AS best_fpr
    FROM cm, {BEST} b)""",
)
def fit_score_evaluate(spark, sf):
    """From the labelled grid to the measures of what was held out: fit, score, evaluate."""
    data, model = _fitted(spark, sf, _fit_near)
    held_out = data.rows.filter(F.col("split") != "train")
    scored = m.score(model, neighbour_features(held_out, "id", "slot", MEASURES, width="6 hours"))
    out = evaluate(stored(scored.select("id", F.col("stage").alias("y"), "p")))
    names = [*RATE_NAMES, "roc_auc", "pr_auc", "best_threshold", "best_tpr", "best_fpr"]
    return rounded(out, *names, digits=8)


@query("flatten_positive", f"WITH {SCORES} SELECT id, 1 AS class, y, p FROM scores")
def flatten_positive(spark, sf):
    return v.flatten_pairs(src.scores(spark, sf), "id", "y", "p")


MICRO = """SELECT id, 1 AS class, y, round(p, 6) AS p FROM scores
    UNION ALL SELECT id, 0, 1 - y, round(1 - p, 6) FROM scores"""


@query("flatten_micro", f"WITH {SCORES} {MICRO}")
def flatten_micro(spark, sf):
    return rounded(v.flatten_pairs(src.scores(spark, sf), "id", "y", "p", "micro"), "p")


@query(
    "flatten_micro_padded",
    f"""WITH {SCORES}, missing AS (
      SELECT id, unnest(range(0, 120 - n)) AS k FROM (
        SELECT id, count(*) AS n FROM scores GROUP BY 1) WHERE n < 120)
    {MICRO} UNION ALL SELECT id, 1, 0, 0.25 FROM missing
    UNION ALL SELECT id, 0, 1, 0.75 FROM missing""",
)
def flatten_micro_padded(spark, sf):
    out = v.flatten_pairs(
        src.scores(spark, sf), "id", "y", "p", "micro_padded", maxlen=120, pad_score=0.25
    )
    return rounded(out, "p")


def linear_score(df):
    z = (F.col("click") + F.col("view") * 2 - F.col("purchase")) / F.lit(100.0)
    return df.withColumn("p", z)


def _swap(col: str) -> str:
    cols = {x: x for x in MEASURES}
    cols[col] = f"coalesce(d.{col}, 0)"
    z = "({click} + {view} * 2 - {purchase}) / 100".format(
        **{k: (w if w != k else f"r.{k}") for k, w in cols.items()}
    )
    return f"""SELECT '{col}' AS feature, round(avg(abs({z} - r.stage)), 6) AS mae
      FROM rows r JOIN donors USING (id)
      LEFT JOIN rows d ON d.id = donors.donor AND d.step = r.step"""


@query(
    "permutation_importance",
    f"""WITH {FILLED}, {LONGEST}, rows AS (
      SELECT id, stage, click, view, purchase,
        maxlen - row_number() OVER (PARTITION BY id ORDER BY slot DESC) AS step
      FROM filled, longest QUALIFY row_number() OVER (PARTITION BY id ORDER BY slot DESC) <= maxlen),
    ids AS (SELECT id, row_number() OVER (ORDER BY (id * 7919 + 7) % 1000, id) AS base,
        row_number() OVER (ORDER BY (id * 7919 + 8) % 1000, id) AS place
      FROM (SELECT DISTINCT id FROM rows)),
    donors AS (SELECT a.id, b.id AS donor FROM ids a JOIN ids b ON a.place = b.base)
    {" UNION ALL ".join(_swap(x) for x in MEASURES)}""",
)
def permutation_importance(spark, sf):
    rows = stored(labelled_of(spark, sf).fillna(0, subset=MEASURES))
    longest = longest_train(rows)
    out = v.permutation_importance(
        rows, "id", "slot", MEASURES, "stage", linear_score, maxlen=longest, seed=7, fn="arithmetic"
    )
    return rounded(out, "mae")
