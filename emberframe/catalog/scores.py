"""Queries on model scores: probabilities, encodings, curves, losses, sampling and models."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.catalog import fixtures
from emberframe.catalog.registry import r, register, rounded
from emberframe.catalog.sql import R, num, query
from emberframe.functions import probability as pr
from emberframe.operators import metrics, model, sampling
from emberframe.session import scratch_path
from emberframe.sources import tables


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.load(spark, d, "prediction")


@register("c17_sigmoid", query(f"SELECT event_id, {R('1 / (1 + exp(-logit))')} AS p FROM prediction", "prediction"))
def c17(spark, d):
    return predictions(spark, d).select("event_id", r(pr.sigmoid(F.col("logit"))).alias("p"))


# Three class scores per row: background, already burned, newly burned.
CLASS_SQL = "SELECT *, logit AS z0, user_id % 7 - 3e0 AS z1, 4 * score - 1 AS z2 FROM prediction"


def class_scores(spark, d) -> DataFrame:
    return predictions(spark, d).withColumns(
        {"z0": F.col("logit"), "z1": F.col("user_id") % 7 - 3.0, "z2": 4 * F.col("score") - 1}
    )


ARGMAX_SQL = "CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END"
Z = ("z0", "z1", "z2")


@register(
    "c18_softmax_argmax",
    query(f"SELECT event_id, {ARGMAX_SQL} AS predicted, {R('exp(z2) / (exp(z0) + exp(z1) + exp(z2))')} AS new_fire, {R('exp(z0) / (exp(z0) + exp(z1) + exp(z2))')} AS background FROM classes", "prediction", classes=CLASS_SQL),
)
def c18(spark, d):
    scores = [F.col(z) for z in Z]
    return class_scores(spark, d).select(
        "event_id", pr.argmax(scores).alias("predicted"), r(pr.new_fire_probability(scores)).alias("new_fire"), r(pr.softmax(scores)[0]).alias("background")
    )


@register("c19_decide", query("SELECT user_id, count(*) FILTER (WHERE score > 5e-2) AS strict, count(*) FILTER (WHERE score >= 5e-2) AS inclusive FROM prediction GROUP BY user_id", "prediction"))
def c19(spark, d):
    count = lambda inclusive: F.count_if(pr.decide(F.col("score"), 0.05, inclusive))
    return predictions(spark, d).groupBy("user_id").agg(count(False).alias("strict"), count(True).alias("inclusive"))


_FREQ = [math.exp(-i * math.log(10000.0) / 7) for i in range(8)]
_AGE = " + ".join([f"{i + 1} * sin(d * {num(f)})" for i, f in enumerate(_FREQ)] + [f"{i + 9} * cos(d * {num(f)})" for i, f in enumerate(_FREQ)])


@register("c20_age_embedding", query(f"SELECT event_id, {R(f'sin(d * {num(_FREQ[1])})')} AS second_sine, {R(_AGE)} AS weighted FROM (SELECT event_id, cast(user_id % 30 AS double) AS d FROM prediction) q", "prediction"))
def c20(spark, d):
    e = predictions(spark, d).select("event_id", pr.age_embedding((F.col("user_id") % 30).cast("double")).alias("e"))
    weighted = F.aggregate(F.transform("e", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("event_id", r(F.element_at("e", 2)).alias("second_sine"), r(weighted).alias("weighted"))


_DENOM = [1000.0 ** (2 * (i // 2) / 6) for i in range(6)]
_POS = " + ".join(f"{i + 1 + 6 * rep} * {'sin' if i % 2 == 0 else 'cos'}(p / {num(w)})" for rep in (0, 1) for i, w in enumerate(_DENOM))


@register("c21_position_encoding", query(f"SELECT event_id, {R(_POS)} AS weighted FROM (SELECT event_id, cast(event_id % 366 AS double) AS p FROM prediction) q", "prediction"))
def c21(spark, d):
    e = predictions(spark, d).select(
        "event_id", pr.position_encoding((F.col("event_id") % 366).cast("double"), 6, repeat=2).alias("e")
    )
    weighted = F.aggregate(F.transform("e", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("event_id", r(weighted).alias("weighted"))


@register(
    "c22_stable_seed",
    query(
        """SELECT event_id, cast('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS bigint) AS seed
           FROM (SELECT event_id, sha256('42|train|' || user_id || '|' || event_id || '|') AS h FROM prediction) q""",
        "prediction",
    ),
)
def c22(spark, d):
    seed = pr.stable_seed(F.lit(42), F.lit("train"), F.col("user_id"), F.col("event_id"))
    return predictions(spark, d).select("event_id", seed.alias("seed"))


@register("c29_safe_divide", query(f"SELECT user_id, {R('CASE WHEN n = 0 THEN 0e0 ELSE cast(p AS double) / n END')} AS ratio FROM (SELECT user_id, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE score > 2e-1) AS n FROM prediction GROUP BY user_id) q", "prediction"))
def c29(spark, d):
    per = predictions(spark, d).groupBy("user_id").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("score") > 0.2).alias("n"))
    return per.select("user_id", r(pr.safe_divide(F.col("p").cast("double"), F.col("n"))).alias("ratio"))


@register("f9_class_selection", query("SELECT event_id, label FROM prediction WHERE label = 1 UNION ALL SELECT event_id, label FROM prediction WHERE label = 0 AND score > 1e-1", "prediction"))
def f9(spark, d):
    p = predictions(spark, d)
    fire, other = sampling.of_class(p, True), sampling.of_class(p, False).where("score > 0.1")
    return fire.unionByName(other).select("event_id", "label")


@register(
    "l3_balanced_sample",
    query("SELECT event_id, label FROM (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || event_id), event_id) AS rn FROM prediction) q WHERE rn <= CASE WHEN label = 1 THEN 150 ELSE 225 END", "prediction"),
)
def l3(spark, d):
    return sampling.balanced_sample(predictions(spark, d), ["event_id"], 150, 1.5).select("event_id", "label")


@register("l4_best_samples", query("SELECT event_id, score FROM prediction ORDER BY score DESC, event_id LIMIT 300", "prediction"))
def l4(spark, d):
    return sampling.best_samples(predictions(spark, d), "score", ["event_id"], 300).select("event_id", "score")


@register("l5_best_model", query("SELECT architecture, run, iou FROM (SELECT *, row_number() OVER (PARTITION BY architecture ORDER BY iou DESC, run) AS rn FROM metrics) q WHERE rn = 1", "metrics"))
def l5(spark, d):
    return metrics.best_of(fixtures.load(spark, d, "metrics"), "iou", "run", ["run"], ("architecture",))


def rates_sql(source: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}tp, fp, fn, tn, {R('CASE WHEN tp + fp + fn = 0 THEN 0e0 ELSE cast(tp AS double) / (tp + fp + fn) END')} AS iou,
        {R('CASE WHEN tp + fp + fn = 0 THEN 0e0 ELSE cast(2 * tp AS double) / (2 * tp + fp + fn) END')} AS dice,
        {R('CASE WHEN tp + fp = 0 THEN 0e0 ELSE cast(tp AS double) / (tp + fp) END')} AS precision,
        {R('CASE WHEN tp + fn = 0 THEN 0e0 ELSE cast(tp AS double) / (tp + fn) END')} AS recall,
        {R('cast(tp + tn AS double) / (tp + fp + fn + tn)')} AS accuracy FROM {source}"""


def counts_sql(source: str, hit: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    f = lambda c, n: f"count(*) FILTER (WHERE {c}) AS {n}"
    parts = [f(f"{hit} AND label = 1", "tp"), f(f"{hit} AND label = 0", "fp"), f(f"NOT ({hit}) AND label = 1", "fn"), f(f"NOT ({hit}) AND label = 0", "tn")]
    return f"SELECT {lead}{', '.join(parts)} FROM {source}" + (f" GROUP BY {keys}" if keys else "")


RATES = ("iou", "dice", "precision", "recall", "accuracy")


@register("a15_binary_metrics", query(rates_sql("counts"), "prediction", counts=counts_sql("prediction", "score >= 5e-2")))
def a15(spark, d):
    return rounded(metrics.binary_metrics(predictions(spark, d), threshold=0.05), *RATES)


CLASS_COUNTS = f"""SELECT c AS class, count(*) FILTER (WHERE t = c AND p = c) AS tp, count(*) FILTER (WHERE t <> c AND p = c) AS fp,
    count(*) FILTER (WHERE t = c AND p <> c) AS fn FROM (SELECT user_id % 3 AS t, {ARGMAX_SQL} AS p FROM classes) q, (VALUES (0), (1), (2), (3)) v(c) GROUP BY c"""
PER_CLASS = f"""SELECT class, tp, fp, fn, CASE WHEN tp + fp + fn = 0 THEN -1e0 ELSE cast(tp AS double) / (tp + fp + fn) END AS iou,
    CASE WHEN tp + fp + fn = 0 THEN -1e0 ELSE cast(2 * tp AS double) / (2 * tp + fp + fn) END AS dice FROM class_counts"""


def _class_pairs(spark, d) -> DataFrame:
    return class_scores(spark, d).select(
        (F.col("user_id") % 3).cast("int").alias("label"), pr.argmax([F.col(z) for z in Z]).alias("predicted")
    )


@register("a16_class_metrics", query(f"SELECT class, tp, fp, fn, {R('iou')} AS iou, {R('dice')} AS dice FROM per_class", "prediction", classes=CLASS_SQL, class_counts=CLASS_COUNTS, per_class=PER_CLASS))
def a16(spark, d):
    return rounded(metrics.class_metrics(_class_pairs(spark, d), 4), "iou", "dice")


@register(
    "a16_macro_metrics",
    query(f"SELECT {R('avg(iou) FILTER (WHERE iou <> -1)')} AS macro_iou, {R('avg(dice) FILTER (WHERE dice <> -1)')} AS macro_dice FROM per_class", "prediction", classes=CLASS_SQL, class_counts=CLASS_COUNTS, per_class=PER_CLASS),
)
def a16_macro(spark, d):
    return rounded(metrics.macro_metrics(metrics.class_metrics(_class_pairs(spark, d), 4)), "macro_iou", "macro_dice")


CURVE_SQL = """SELECT score AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM
    (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM prediction GROUP BY score) q
    WINDOW w AS (ORDER BY score DESC)"""


@register("w8_cumulative_counts", query(f"SELECT threshold, cast(tp AS bigint) AS tp, cast(fp AS bigint) AS fp, {R('cast(tp AS double) / (tp + fp)')} AS precision FROM curve", "prediction", curve=CURVE_SQL))
def w8(spark, d):
    return rounded(metrics.pr_curve(predictions(spark, d)).select("threshold", "tp", "fp", "precision"), "precision")


SUMMARY_SQL = f"""SELECT {R('sum(pos * (p + coalesce(before, 1e0)) / 2) / sum(pos)')} AS auc_pr, {R('sum(pos * p) / sum(pos)')} AS average_precision,
    cast(sum(pos) AS bigint) AS positive_rows, cast(sum(neg) AS bigint) AS negative_rows
    FROM (SELECT *, lag(p) OVER (ORDER BY threshold DESC) AS before FROM (SELECT *, cast(tp AS double) / (tp + fp) AS p FROM curve) a) b"""


@register("a17_exact_pr_summary", query(SUMMARY_SQL, "prediction", curve=CURVE_SQL))
def a17(spark, d):
    return rounded(metrics.pr_summary(predictions(spark, d)), "auc_pr", "average_precision")


# Scores of k / 199 lie on a threshold; the comparison is with the threshold itself.
BINNED_SQL = """SELECT b AS bin, count(*) FILTER (WHERE score >= b / 199e0 AND label = 1) AS tp, count(*) FILTER (WHERE score >= b / 199e0 AND label = 0) AS fp,
    count(*) FILTER (WHERE label = 1) AS positives FROM (SELECT score, label FROM prediction UNION ALL SELECT (event_id % 200) / 199e0, label FROM prediction) q,
    (SELECT unnest(range(200)) AS b) t GROUP BY b"""
BINNED_CURVE = "SELECT bin, CASE WHEN tp + fp = 0 THEN 1e0 ELSE cast(tp AS double) / (tp + fp) END AS p, cast(tp AS double) / positives AS rec FROM binned"


@register(
    "a18_binned_pr_summary",
    query(
        f"""SELECT {R('sum((rec - nr) * p)')} AS average_precision, {R('sum((rec - nr) * (p + np) / 2)')} AS auc_pr FROM
            (SELECT *, coalesce(lead(rec) OVER (ORDER BY bin), 0e0) AS nr, coalesce(lead(p) OVER (ORDER BY bin), 1e0) AS np FROM c) q""",
        "prediction", binned=BINNED_SQL, c=BINNED_CURVE,
    ),
)
def a18(spark, d):
    scored = predictions(spark, d).select("event_id", "score", "label")
    edges = scored.withColumn("score", (F.col("event_id") % 200) / F.lit(199.0))
    return rounded(metrics.binned_pr_summary(scored.unionByName(edges)), "average_precision", "auc_pr")


_BCE = "(greatest(logit, 0e0) + ln(1 + exp(-abs(logit))) - logit * label)"


@register(
    "a19_losses",
    query(
        f"""SELECT {R('bce')} AS bce, {R('focal')} AS focal, {R('dice')} AS dice_loss, {R('0.5e0 * focal + 0.5e0 * dice')} AS combined FROM (
              SELECT avg({_BCE}) AS bce, avg(CASE WHEN label = 1 THEN 0.85e0 ELSE 0.15e0 END * pow(1 - exp(-{_BCE}), 2) * {_BCE}) AS focal,
                     1 - (2 * sum(s * label) + 1e-6) / (sum(s) + sum(label) + 1e-6) AS dice
              FROM (SELECT *, 1 / (1 + exp(-logit)) AS s FROM prediction) q) u""",
        "prediction",
    ),
)
def a19(spark, d):
    return rounded(metrics.loss_metrics(predictions(spark, d)), "bce", "focal", "dice_loss", "combined")


@register(
    "a19_weighted_cross_entropy",
    query(
        f"""SELECT {R('sum(w * (ln(exp(z0) + exp(z1) + exp(z2)) - z)) / sum(w)')} AS cross_entropy FROM (
              SELECT *, CASE user_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 1e1 ELSE 5e1 END AS w, CASE user_id % 3 WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END AS z FROM classes) q""",
        "prediction", classes=CLASS_SQL,
    ),
)
def a19_ce(spark, d):
    rows = class_scores(spark, d).withColumn("label", F.col("user_id") % 3)
    return rounded(metrics.weighted_cross_entropy(rows, list(Z)), "cross_entropy")


@register("a20_class_weights", query(f"SELECT {R('3e0 * count(*) / count(*) FILTER (WHERE label = 0)')} AS no_fire_weight, {R('cast(count(*) AS double) / count(*) FILTER (WHERE label = 1)')} AS fire_weight FROM prediction", "prediction"))
def a20(spark, d):
    return rounded(metrics.class_weights(predictions(spark, d), 3.0), "no_fire_weight", "fire_weight")


def matrix(spark, d) -> DataFrame:
    """Three features and a label per row."""
    return predictions(spark, d).select(
        "event_id", "label", F.array("score", "logit", (F.col("user_id") / 100.0)).alias("features")
    )


@register(
    "a21_standard_scaler",
    query(" UNION ALL ".join(f"SELECT {i} AS i, {R(f'avg({c})')} AS mean, {R(f'stddev_pop({c})')} AS std FROM prediction" for i, c in enumerate(("score", "logit", "user_id / 1e2"))), "prediction"),
)
def a21(spark, d):
    return rounded(model.fit_scaler(matrix(spark, d)), "mean", "std")


@register(
    "m2_train_logistic",
    query(
        """SELECT w, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, 0e0 AS slope_0, 0e0 AS slope_1, 0e0 AS slope_2, 0e0 AS intercept
           FROM prediction, (VALUES (1e0), (2e0), (3e0), (4e0), (5e0), (6e0), (7e0), (8e0)) t(w) GROUP BY w""",
        "prediction",
    ),
)
def m2(spark, d):
    """Fitted on the table itself. The coefficients depend on the solver's path; at the optimum the gradient is zero."""
    rows = matrix(spark, d)
    scaled = model.standardise(rows, model.fit_scaler(rows))
    fitted = model.train_sweep(scaled, [float(w) for w in range(1, 9)])
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"))
    flat = lambda c: F.round(c, 3) + F.lit(0.0)
    out = [
        model.loss_gradient(scaled, w, coef, b).crossJoin(counts).select(  # one row each
            F.lit(w).alias("w"), "rows", "positives", *[flat(F.col("slopes")[i]).alias(f"slope_{i}") for i in range(3)], flat(F.col("intercept")).alias("intercept")
        )
        for w, (coef, b) in fitted.items()
    ]
    return reduce(DataFrame.unionByName, out)


# Fixed coefficients: scoring and evaluation are deterministic given a model.
MODELS = {1.0: ([4.0, 0.5, -0.02], 0.3), 2.0: ([-3.0, 0.2, 0.05], -0.4)}


def _z(coef, b) -> str:
    c = [num(x) for x in coef]
    return f"({c[0]} * score + {c[1]} * logit + {c[2]} * (user_id / 1e2) + {num(b)})"


SCORED_SQL = "SELECT event_id, label, " + ", ".join(f"round(1 / (1 + exp(-{_z(c, b)})), 4) AS p_{i}" for i, (c, b) in enumerate(MODELS.values())) + " FROM prediction"


def scored(spark, d) -> DataFrame:
    """Scores rounded to four digits, so that both engines see the same ties."""
    return rounded(model.score_models(matrix(spark, d), MODELS), "p_0", "p_1", digits=4)


@register("m3_score_models", query("SELECT event_id, p_0, p_1 FROM scored", "prediction", scored=SCORED_SQL))
def m3(spark, d):
    return scored(spark, d).select("event_id", "p_0", "p_1")


LONG_SQL = "SELECT 0 AS ord, 1e0 AS w, p_0 AS score, label FROM scored UNION ALL SELECT 1, 2e0, p_1, label FROM scored"
LONG_CURVE = """SELECT ord, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM
    (SELECT ord, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM long GROUP BY ord, score) q
    WINDOW w AS (PARTITION BY ord ORDER BY score DESC)"""
EVAL_SQL = f"""SELECT * FROM ({rates_sql('counts', 'ord, w')}) a JOIN (
    SELECT ord, {R('sum(pos * (p + coalesce(before, 1e0)) / 2) / sum(pos)')} AS auc_pr, {R('sum(pos * p) / sum(pos)')} AS average_precision,
           cast(sum(pos) AS bigint) AS positive_rows, cast(sum(neg) AS bigint) AS negative_rows
    FROM (SELECT *, lag(p) OVER (PARTITION BY ord ORDER BY score DESC) AS before FROM (SELECT *, cast(tp AS double) / (tp + fp) AS p FROM curves) c) d
    GROUP BY ord) b USING (ord)"""


@register("m5_evaluate_models", query(EVAL_SQL, "prediction", scored=SCORED_SQL, long=LONG_SQL, counts=counts_sql("long", "score >= 5e-1", "ord, w"), curves=LONG_CURVE))
def m5(spark, d):
    return rounded(model.evaluate(scored(spark, d), list(MODELS)), *RATES, "auc_pr", "average_precision")


@register("m4_sweep_selection", query("SELECT w, auc_pr FROM e ORDER BY auc_pr DESC, ord LIMIT 1", "prediction", scored=SCORED_SQL, long=LONG_SQL, counts=counts_sql("long", "score >= 5e-1", "ord, w"), curves=LONG_CURVE, e=EVAL_SQL))
def m4(spark, d):
    return rounded(model.select_best(model.evaluate(scored(spark, d), list(MODELS))), "auc_pr")


METRIC_SCHEMA = "architecture string, run int, iou double, n bigint"


@register("s9_append_metrics", query("SELECT * FROM metrics UNION ALL SELECT * FROM metrics", "metrics"))
def s9(spark, d):
    path = scratch_path(spark, "metrics")
    rows = fixtures.load(spark, d, "metrics")
    tables.append_metrics(rows, path)
    tables.append_metrics(rows, path)
    return tables.read_metrics(spark, path, METRIC_SCHEMA)


@register("a27_results_by_run", query('SELECT architecture, max(CASE WHEN run = 1 THEN iou END) AS run_1, max(CASE WHEN run = 2 THEN iou END) AS run_2, max(CASE WHEN run = 3 THEN iou END) AS run_3 FROM metrics GROUP BY architecture', "metrics"))
def a27(spark, d):
    return metrics.results_by_run(fixtures.load(spark, d, "metrics"), "iou", [1, 2, 3])
