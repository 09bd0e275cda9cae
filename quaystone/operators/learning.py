"""Explainable models over the feature panel: training panel, linear models as tables, contributions, blended scores, tree rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import indicators as ind
from . import series
from .folds import FoldModels, day_number, fold_cuts
from .models import probability_model
from ..functions.scalars import finite

#: Features of the models and their categories.
CATEGORIES = {
    "trend_momentum": ("return_5d", "return_20d", "ma20_gap_pct", "ma60_gap_pct", "ma_alignment", "macd_hist", "rsi", "boll_position"),
    "volume_money": ("volume_ratio_5", "volume_ratio_20", "amount_yi", "turnover_inferred", "money_flow_proxy"),
    "volatility_risk": ("volatility_20d", "max_drawdown_20d", "intraday_range_pct", "from_20d_high_pct"),
    "market_context": ("market_state_score", "market_offensive", "market_defensive"),
    "fundamental_news": ("news_total_score", "news_net_score"),
}
FEATURES = tuple(f for names in CATEGORIES.values() for f in names)
TARGETS = ("label_up", "label_drawdown")
LABELS = ("future_return", "future_max_drawdown", "label_up", "label_drawdown", "risk_adjusted_return")


def context(df: DataFrame, score: Column | float = 50.0, state: Column | str = "neutral", news_total: Column | float = 50.0, news_net: Column | float = 0.0) -> DataFrame:
    """Market and news features of each row; neutral where nothing is given."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    state = F.coalesce(as_column(state), F.lit("neutral"))
    return df.withColumns({
        "market_state_score": F.coalesce(as_column(score), F.lit(50.0)), "market_offensive": (state == "offensive").cast("double"), "market_defensive": (state == "defensive").cast("double"),
        "news_total_score": F.coalesce(as_column(news_total), F.lit(50.0)), "news_net_score": F.coalesce(as_column(news_net), F.lit(0.0)),
    })


def training_panel(bars: DataFrame, *, horizon: int = 15, target: float = 0.08, drawdown: float = 0.06, least_bars: int = 100, step: int = 1, start=None, end=None, digits: int | None = None) -> DataFrame:
    """symbol, date, FEATURES and LABELS of all complete rows of symbols with at least ``least_bars`` bars, in neutral context.

    Every ``step``-th of a symbol's complete rows between ``start`` and ``end`` stays; null and non-finite numbers become 0, rounded to ``digits`` if given.
    Rows are chosen, filled and rounded in the pass that computes the features.
    """
    known = lambda f: ~np.isnan(f["future_return"]) & ~np.isnan(f["future_max_drawdown"])
    formulas = series.forward(horizon) | {
        "max_drawdown_20d": lambda f: f["from_20d_high_pct"],
        "label_up": lambda f: (f["future_return"] >= target).astype(float), "label_drawdown": lambda f: (f["future_max_drawdown"] <= -drawdown).astype(float),
        "risk_adjusted_return": lambda f: f["future_return"] + 0.45 * f["future_max_drawdown"], "_complete": lambda f: known(f) & (f["n_bars"] >= least_bars),
    }
    made = [*(c for c in FEATURES if c in (*ind.FEATURES, *ind.RECURSIVE, "rsi", "max_drawdown_20d")), *LABELS]
    df = context(ind.with_columns(bars, made, ("symbol", "date"), formulas, where="_complete", whole=True, digits=digits))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    df = ind.every_kth(df, step) if step > 1 else df
    return df.select("symbol", "date", *FEATURES, *LABELS)


ROW = "array<struct<feature:string,mean:double,scale:double,up_coef:double,dd_coef:double>>"


def moments(panel: DataFrame, features=FEATURES) -> DataFrame:
    """feature, n, mean, population deviation and covariances with both labels of each feature and label, with the labels' sums and deviations.

    One pass of arrays over the panel leaves a row a task and column, centred on the task's own means; these are then moved to the
    common mean, so that a constant column keeps a deviation of 0.  Null counts as 0.
    """
    names = [*features, *TARGETS]

    def run(batches):
        n, mean, own, cross = 0, np.zeros(len(names)), np.zeros(len(names)), np.zeros((len(names), len(TARGETS)))
        sums = np.zeros(len(TARGETS))
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = np.stack([batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in names])
            here = x.mean(axis=1)
            d, gap = x - here[:, None], here - mean
            share = n * m / (n + m)
            own += np.einsum("ij,ij->i", d, d) + gap**2 * share
            cross += d @ d[-len(TARGETS) :].T + np.outer(gap, gap[-len(TARGETS) :]) * share
            mean = mean + gap * (m / (n + m))
            sums += x[-len(TARGETS) :].sum(axis=1)
            n += m
        if n:
            same = lambda v: pa.array(np.full(len(names), v))
            up, dd = mean[-2:]
            yield pa.record_batch(
                [pa.array(names), same(n), pa.array(mean), pa.array(own), pa.array(cross[:, 0].copy()), pa.array(cross[:, 1].copy()), same(up), same(dd), same(sums[0]), same(sums[1])],
                names=["feature", "n", "mean", "own", "up", "dd", "up_mean", "dd_mean", "up_sum", "dd_sum"],
            )

    schema = "feature string, n long, mean double, own double, up double, dd double, up_mean double, dd_mean double, up_sum double, dd_sum double"
    parts = panel.select(*(F.col(c).cast("double").alias(c) for c in names)).mapInArrow(run, schema)
    w = Window.partitionBy("feature")  # one row a task
    centre = {f"_{c}": F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w) for c in ("mean", "up_mean", "dd_mean")}
    gap = lambda c: F.col(c) - F.col(f"_{c}")
    moved = lambda c, other: F.sum(F.col(c) + F.col("n") * gap("mean") * gap(other)) / F.sum("n")
    return parts.withColumns(centre).groupBy("feature").agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sqrt(moved("own", "mean")).alias("spread"), moved("up", "up_mean").alias("up"), moved("dd", "dd_mean").alias("dd"),
        F.sum("up_sum").alias("up_sum"), F.sum("dd_sum").alias("dd_sum"),
    )


def correlation_model(panel: DataFrame, features=FEATURES) -> DataFrame:
    """One row: a model whose coefficients are each feature's correlations with both labels, from one pass over the panel.

    Columns: ``terms`` (one struct a feature: mean, population deviation, coefficients), up_bias, dd_bias (log odds of the labels) and n.
    """
    zero = lambda x: F.coalesce(finite(x), F.lit(0.0))
    of = lambda name: F.max(F.when(F.col("feature") == name, F.struct("mean", "spread", "up", "dd")))
    odds = lambda c: F.log((F.max(c) + 0.5) / (F.max("n") - F.max(c) + 0.5))
    got = moments(panel, features).agg(*(of(c).alias(f"m_{c}") for c in (*features, *TARGETS)), odds("up_sum").alias("up_bias"), odds("dd_sum").alias("dd_bias"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    # corr() itself divides by a constant column's deviation
    corr = lambda m, part, label: F.when(m.spread > 1e-9, zero(F.try_divide(m[part], m.spread * F.col(f"m_{label}.spread")))).otherwise(0.0)
    terms = [
        F.struct(
            F.lit(c).alias("feature"), m["mean"].alias("mean"), F.when(m.spread > 1e-9, m.spread).otherwise(1.0).alias("scale"),
            corr(m, "up", "label_up").alias("up_coef"), corr(m, "dd", "label_drawdown").alias("dd_coef"),
        )
        for c, m in ((c, F.col(f"m_{c}")) for c in features)
    ]
    return got.select(F.array(*terms).alias("terms"), "up_bias", "dd_bias", "n")


def fitted_model(panel: DataFrame, features=FEATURES) -> DataFrame:
    """The same table from two fitted, standardised, class-balanced logistic regressions; a constant label has no coefficients."""
    spark = panel.sparkSession
    parts = {}
    for name, label in (("up", "label_up"), ("dd", "label_drawdown")):
        model, prior = probability_model(panel, list(features), label)
        if model is None:
            odds = float("inf") if prior else float("-inf")
            parts[name] = (max(-20.0, min(20.0, odds)), [0.0] * len(features))
        else:
            parts[name] = (float(model.stages[-1].intercept), [float(x) for x in model.stages[-1].coefficients])
            # a pipeline scales by the sample deviation; every model over one panel has the same one
            parts["scale"] = [(float(m), float(s) if s > 0 else 1.0) for m, s in zip(model.stages[1].mean, model.stages[1].std, strict=True)]
    scale = parts.get("scale", [(0.0, 1.0)] * len(features))
    terms = [(f, m, s, u, d) for f, (m, s), u, d in zip(features, scale, parts["up"][1], parts["dd"][1], strict=True)]
    return spark.createDataFrame([(terms, parts["up"][0], parts["dd"][0], panel.count())], f"terms {ROW}, up_bias double, dd_bias double, n long")


def importance(model: DataFrame) -> DataFrame:
    """feature, category, both coefficients and |up| + 0.7 |dd|, with its rank."""
    category = F.create_map(*(F.lit(x) for name, fs in CATEGORIES.items() for f in fs for x in (f, name)))
    out = model.select(F.explode("terms").alias("t")).select("t.*").withColumn("category", F.coalesce(category[F.col("feature")], F.lit("unknown")))
    out = out.withColumn("importance", F.round(F.abs("up_coef") + 0.7 * F.abs("dd_coef") + 1e-9, 6))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("importance"), "feature")  # one row a feature
    return out.select("feature", "category", "up_coef", "dd_coef", "importance", F.row_number().over(w).alias("pos"))


def with_model(df: DataFrame, model: DataFrame, features=FEATURES) -> DataFrame:
    """``df`` with ``z``: a struct a feature of its value and its contributions to both probabilities; the model is one row."""
    values = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features))
    out = df.join(F.broadcast(model.select("terms", "up_bias", "dd_bias")))

    def term(x, t):
        z = (x - t.mean) / t.scale
        return F.struct(t.feature.alias("feature"), x.alias("value"), (z * t.up_coef).alias("up"), (z * t.dd_coef).alias("dd"))

    return out.withColumn("z", F.zip_with(values, "terms", term)).drop("terms")


def ranked_contributions(df: DataFrame, model: DataFrame, keys: list[str], *, n: int = 10, features=FEATURES) -> DataFrame:
    """The ``n`` features of each row that move its outlook most (up - 0.65 dd), by size, ranked within the row's array."""
    each = F.transform("z", lambda t: F.struct((-F.abs(F.round(t.up - 0.65 * t.dd + 1e-9, 6))).alias("o"), t.feature.alias("feature"), t.value.alias("value"), F.round(t.up - 0.65 * t.dd + 1e-9, 6).alias("contribution")))
    out = with_model(df, model, features).select(*keys, F.posexplode(F.slice(F.array_sort(each), 1, n)))
    return out.select(*keys, (F.col("pos") + 1).alias("pos"), "col.feature", "col.value", "col.contribution", F.when(F.col("col.contribution") >= 0, "positive").otherwise("negative").alias("direction"))


def blended_prediction(df: DataFrame, model: DataFrame, *, take: float = 0.14, stop: float = 0.08, live_ready: bool = False, features=FEATURES) -> DataFrame:
    """``df`` with model_up, model_dd, model_edge and model_score: probability, risk, evidence and liquidity in fixed shares."""
    total = lambda part, bias: F.aggregate("z", F.col(bias), lambda a, t: a + t[part])
    out = with_model(df, model, features).withColumns({"model_up": 1 / (1 + F.exp(-total("up", "up_bias"))), "model_dd": 1 / (1 + F.exp(-total("dd", "dd_bias")))})
    out = out.withColumn("model_edge", (F.col("model_up") * take - F.col("model_dd") * stop) * 100)
    bound = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    score = 0.42 * bound(50 + 9 * F.col("model_edge")) + 0.28 * bound(100 * (1 - F.col("model_dd"))) + 0.20 * (82.0 if live_ready else 58.0) + 0.10 * bound(5 * F.coalesce("amount_yi", F.lit(0.0)))
    return out.withColumn("model_score", score).drop("z", "up_bias", "dd_bias")


def walk_forward(panel: DataFrame, label: str, *, features=FEATURES, gap_days: int = 0) -> DataFrame:
    """Out-of-fold (fold, date, y, p) over expanding folds on whole dates; the last ``gap_days`` before a fold are not learned from.

    Labels look ahead: with a gap of their horizon no training row knows a tested day.  One fit a fold; ``walk_forward_counts`` fits all folds and
    labels together.
    """
    from pyspark.ml.functions import vector_to_array

    day, cuts, out = day_number(), fold_cuts(panel), None
    for k, cut in enumerate(cuts):
        high = cuts[k + 1] if k + 1 < len(cuts) else float("inf")
        test = panel.where((day > cut) & (day <= high))
        model, prior = probability_model(panel.where(day <= cut - gap_days), list(features), label)
        p = test.withColumn("p", F.lit(prior)) if model is None else model.transform(test).withColumn("p", vector_to_array("_prob")[1])
        part = p.select(F.lit(k).alias("fold"), "date", F.col(label).cast("int").alias("y"), "p")
        out = part if out is None else out.unionByName(part)
    return out


def walk_forward_counts(panel: DataFrame, labels=TARGETS, *, features=FEATURES, gap_days: int = 0, stored: bool = False) -> DataFrame:
    """What ``walk_forward`` tells of several labels, as counts: (label, fold, p, n, pos) with p to six digits; all models are fitted in common passes.

    ``stored``: the panel is whole Parquet files as written, which the passes then read on their own.
    """
    models = FoldModels(panel, list(features), list(labels), fold_cuts(panel), gap_days, stored)
    counts = models.tested(panel).groupBy("label", "fold", "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    return counts.withColumn("label", F.element_at(F.array(*(F.lit(x) for x in labels)), F.col("label") + 1))


def fit_tree(panel: DataFrame, label: str, *, features=FEATURES, max_depth: int = 4, least_rows: int = 30, max_bins: int = 64):
    """A decision tree on distributed histograms; depth 3 to 5."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(panel.withColumn(label, F.col(label).cast("double")))
    depth = max(3, min(5, max_depth))
    return DecisionTreeClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, minInstancesPerNode=least_rows, maxBins=max_bins, seed=42).fit(rows)


def leaves(model, features=FEATURES) -> list[tuple[int, list[tuple[str, str, float]]]]:
    """(leaf number from the left, its conditions) of a tree; at most 2 ** depth leaves."""
    found: list = []

    def walk(node, path):
        if "Leaf" in node.getClass().getSimpleName():
            found.append((len(found), path))
            return
        split = node.split()
        name, cut = features[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), [*path, (name, "<=", cut)])
        walk(node.rightChild(), [*path, (name, ">", cut)])

    walk(model._java_obj.rootNode(), [])
    return found


def leaf_of(rules: list[tuple[int, list[tuple[str, str, float]]]]) -> Column:
    """The leaf whose conditions a row meets."""
    out = None
    for leaf, path in rules:
        holds = F.lit(True)
        for name, op, cut in path:
            holds = holds & (F.col(name) <= cut if op == "<=" else F.col(name) > cut)
        out = F.when(holds, leaf) if out is None else out.when(holds, leaf)
    return out


def tree_rules(panel: DataFrame, label: str, *, features=FEATURES, **how) -> DataFrame:
    """leaf, rule, depth, n and the share of ``label``: the tree's leaves as rules, counted over the panel."""
    spark: SparkSession = panel.sparkSession
    rules = leaves(fit_tree(panel, label, features=features, **how), features)
    named = [(leaf, " and ".join(f"{n} {op} {cut:.6g}" for n, op, cut in path) or "all", len(path)) for leaf, path in rules]
    counts = panel.groupBy(leaf_of(rules).alias("leaf")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("share"))
    return spark.createDataFrame(named, "leaf int, rule string, depth int").join(counts, "leaf", "left").fillna(0, ["n"])
