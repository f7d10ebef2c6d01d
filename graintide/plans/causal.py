"""Fixed effects, bootstrap and double machine learning, from sums that Spark gathers.

Every estimate needs only products summed over rows, so the rows stay where they
are and what is solved has one small row a key: commodities, tiers or folds.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide import registry, views
from graintide.shared import keep


def _p(z: float) -> float:
    """Share of a normal variable beyond z on either side."""
    return math.erfc(abs(z) / math.sqrt(2))


def products(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, number of rows, and the sum of the product of each two columns, as p0, p1, ... by row of the upper triangle."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])


def gram(row: pd.Series, size: int) -> np.ndarray:
    """The symmetric matrix of a row of ``products``."""
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = [row[f"p{k}"] for k in range(size * (size + 1) // 2)]
    return out + np.triu(out, 1).T


def demeaned(rows: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """rows with each column less its mean over the group."""
    means = rows.groupBy(*group).agg(*[F.avg(c).alias(f"_{c}") for c in names])
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"m.{c}")) for c in group]
    return rows.alias("l").join(means.alias("m"), same).select(*[F.col(f"l.{c}") for c in rows.columns if c not in names], *[(F.col(f"l.{c}") - F.col(f"m._{c}")).alias(c) for c in names])


_EFFECTS = "commodity string, n long, n_districts long, coefficient double, std_error double, p_value double, r_squared double"


def fixed_effects(rows: DataFrame, cutoff: float = -19.0, least: int = 30) -> DataFrame:
    """Price on a deficit mark and the departure, with district and calendar-month effects, for each commodity.

    District effects go by demeaning; month marks are demeaned with the rest and solved for.
    rows: commodity, state, district, month, avg_price, departure_pct; null prices or departures are left out.
    """
    months = [f"m{k}" for k in range(2, 13)]
    names = ["y", "below", "dep", *months]
    rows = rows.filter("avg_price IS NOT NULL AND departure_pct IS NOT NULL")
    cells = [F.col("avg_price").alias("y"), (F.col("departure_pct") < cutoff).cast("double").alias("below"), F.col("departure_pct").alias("dep"), *[(F.col("month") == k).cast("double").alias(f"m{k}") for k in range(2, 13)]]
    marked = rows.select("commodity", "state", "district", *cells)
    sums = products(demeaned(marked, ["commodity", "state", "district"], names), ["commodity"], names)
    total = marked.groupBy("commodity").agg((F.var_pop("y") * F.count("y")).alias("spread"))
    places = rows.groupBy("commodity").agg(F.countDistinct("state", "district").alias("n_districts"))

    def solve(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for _, row in pdf.iterrows():
                whole = gram(row, len(names))
                keep = [k for k in range(1, len(names)) if whole[k, k] > 1e-9]
                inner, inverse = whole[np.ix_(keep, keep)], np.linalg.pinv(whole[np.ix_(keep, keep)])
                beta = inverse @ whole[keep, 0]
                left = whole[0, 0] - 2 * beta @ whole[keep, 0] + beta @ inner @ beta
                free = row["n"] - row["n_districts"] - len(keep)
                if row["n"] < least or free <= 0 or keep[0] != 1:
                    continue
                se = math.sqrt(max(left, 0) / free * inverse[0, 0])
                out.append((row["commodity"], int(row["n"]), int(row["n_districts"]), beta[0], se, _p(beta[0] / se) if se > 0 else 1.0, 1 - left / row["spread"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _EFFECTS.split(", ")])

    return sums.join(total, "commodity").join(places, "commodity").mapInPandas(solve, _EFFECTS)


_PANEL = "SELECT commodity, state, district, sub_division, year, month, avg_price, n, departure_pct FROM panel"


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 4) for c in names})


@registry.register("fixed_effects")
def fixed_effects_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deficit coefficient of every commodity under district and month effects."""
    return _rounded(fixed_effects(views.run(spark, sf_dir, _PANEL)), "coefficient", "std_error", "p_value", "r_squared")


_MARGIN = "n long, coefficient double, std_error double, low double, high double, p_value double, r_squared double"


def retail_fixed_effects(rows: DataFrame) -> DataFrame:
    """Margin on the discount in per cent, with category and region effects: one row.

    Category effects go by demeaning, however many categories there are; regions, which are few, are marks.
    """
    regions = [x.region for x in rows.select("region").distinct().orderBy("region").collect()[1:]]
    names = ["y", "d", *[f"k{i}" for i in range(len(regions))]]
    cells = [F.col("profit_margin").alias("y"), (F.col("discount") * 100).alias("d"), *[F.coalesce((F.col("region") == v).cast("double"), F.lit(0.0)).alias(f"k{i}") for i, v in enumerate(regions)]]
    marked = rows.filter("profit_margin IS NOT NULL AND discount IS NOT NULL").select("category", *cells)
    sums = products(demeaned(marked, ["category"], names), [], names)
    total = marked.agg((F.var_pop("y") * F.count("y")).alias("spread"), (F.count_distinct("category") + F.max(F.col("category").isNull().cast("int"))).alias("groups"))

    def solve(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for _, row in pdf[pdf["n"] > pdf["groups"] + len(names)].iterrows():
                whole = gram(row, len(names))
                free = [k for k in range(1, len(names)) if whole[k, k] > 1e-9]
                if free[:1] != [1]:
                    continue
                inner, inverse = whole[np.ix_(free, free)], np.linalg.pinv(whole[np.ix_(free, free)])
                beta = inverse @ whole[free, 0]
                left = whole[0, 0] - 2 * beta @ whole[free, 0] + beta @ inner @ beta
                se = math.sqrt(max(left, 0) / (row["n"] - row["groups"] - len(free)) * inverse[0, 0])
                out.append((int(row["n"]), beta[0], se, beta[0] - 1.96 * se, beta[0] + 1.96 * se, _p(beta[0] / se) if se > 0 else 1.0, 1 - left / row["spread"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _MARGIN.split(", ")])

    return sums.crossJoin(total).mapInPandas(solve, _MARGIN)  # one row each


@registry.register("retail_fixed_effects")
def retail_fixed_effects_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin points a point of discount."""
    rows = views.run(spark, sf_dir, "SELECT profit_margin, discount, category, region FROM sales")
    return _rounded(retail_fixed_effects(rows), "coefficient", "std_error", "low", "high", "p_value", "r_squared")


#: Upper ends of the shares of a Poisson variable of mean 1 that is 0, 1, ... or less.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Poisson weights of every draw (rows) and key (columns), from a hash of both alone."""
    x = keys.astype(np.uint64)[None, :] + (draws.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64, "right").astype(np.float64)


def bootstrap_tiers(rows: DataFrame, key: list[str], draws: int = 1000, seed: int = 42, least: int = 3) -> DataFrame:
    """Mean margin and loss rate of each tier with 95 % limits of a Poisson bootstrap.

    A row's weight in a draw follows from the seed, the draw and the row's key, so limits are the
    same however rows are dealt.  Each task sends one sum a tier and draw, so what is shuffled doesn't grow with the rows.
    Null tiers are a tier; tiers of fewer than ``least`` rows have no limits.
    rows: tier, margin, is_loss and the columns of a key that no two rows share.
    """

    def resample(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str | None, np.ndarray] = {}
        for pdf in pdfs:
            for tier, own in pdf.groupby("tier", dropna=False):
                total = sums.setdefault(None if pd.isna(tier) else tier, np.zeros((draws, 3)))
                x, hashes = np.column_stack([np.ones(len(own)), own[["margin", "is_loss"]].to_numpy(float)]), own["h"].to_numpy()
                for at in range(0, len(x), 2000):
                    total += _weights(hashes[at : at + 2000], np.arange(draws)) @ x[at : at + 2000]
        for tier, total in sums.items():
            yield pd.DataFrame({"tier": tier, "draw": np.arange(draws), "w": total[:, 0], "margin": total[:, 1], "loss": total[:, 2]})

    cells = rows.select("tier", F.col("margin").cast("double").alias("margin"), F.col("is_loss").cast("double").alias("is_loss"), F.xxhash64(F.lit(seed), *key).alias("h"))
    drawn = cells.filter("margin IS NOT NULL AND is_loss IS NOT NULL").mapInPandas(resample, "tier string, draw int, w double, margin double, loss double")
    means = drawn.groupBy("tier", "draw").agg(*[(F.sum(c) / F.nullif(F.sum("w"), F.lit(0.0))).alias(c) for c in ("margin", "loss")])
    limit = lambda c, q: F.percentile(c, F.lit(q))
    limits = means.groupBy("tier").agg(limit("margin", 0.025).alias("margin_low"), limit("margin", 0.975).alias("margin_high"), limit("loss", 0.025).alias("loss_low"), limit("loss", 0.975).alias("loss_high"))
    whole = rows.groupBy("tier").agg(F.count("*").alias("n"), F.avg("margin").alias("mean_margin"), F.avg("is_loss").alias("loss_rate"))
    known: Column = F.col("n") >= least
    return whole.alias("a").join(limits.alias("b"), F.col("a.tier").eqNullSafe(F.col("b.tier"))).select("a.tier", "n", "mean_margin", "loss_rate", *[F.when(known, F.col(c)).alias(c) for c in ("margin_low", "margin_high", "loss_low", "loss_high")])


@registry.register("bootstrap_tiers")
def bootstrap_tiers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount tiers with bootstrap limits."""
    rows = views.run(spark, sf_dir, "SELECT discount_tier AS tier, profit_margin AS margin, is_loss, order_id, line_no FROM sales")
    return _rounded(bootstrap_tiers(rows, ["order_id", "line_no"]), "mean_margin", "loss_rate", "margin_low", "margin_high", "loss_low", "loss_high")


def double_ml(rows: DataFrame, outcome: str, dose: str, controls: list[str], key: Column, folds: int = 2, least: int = 100, ridge: float = 1e-6) -> dict[str, float] | None:
    """Cross-fitted effect of dose on outcome given controls, or None below ``least`` rows.

    Outcome and dose are predicted in each fold from regressions, on controls and their
    squares, that the other folds' rows gave; the effect is the residuals' regression.  Folds follow from a hash of ``key``.
    """
    terms = ["_one", *[f"_x{k}" for k in range(2 * len(controls))]]
    scale = rows.agg(*[F.avg(c).alias(f"a{k}") for k, c in enumerate(controls)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(controls)]).first()
    x = [(F.col(c) - F.lit(scale[f"a{k}"])) / F.lit(scale[f"s{k}"] or 1.0) for k, c in enumerate(controls)]
    rows = rows.select(F.col(outcome).cast("double").alias("_y"), F.col(dose).cast("double").alias("_d"), F.lit(1.0).alias("_one"), *[c.alias(f"_x{k}") for k, c in enumerate([*x, *[v * v for v in x]])], F.pmod(F.xxhash64(key), F.lit(folds)).alias("_fold")).dropna()
    names = ["_y", "_d", *terms]
    sums = products(rows, ["_fold"], names).toPandas()  # one row a fold
    if sums["n"].sum() < least or len(sums) < 2:
        return None
    grams = {row["_fold"]: gram(row, len(names)) for _, row in sums.iterrows()}
    guess_y, guess_d = F.lit(None).cast("double"), F.lit(None).cast("double")
    for fold in grams:
        other = sum(g for k, g in grams.items() if k != fold)
        beta = np.linalg.solve(other[2:, 2:] + ridge * np.eye(len(terms)) * other[2, 2], other[2:, :2])
        at = F.col("_fold") == int(fold)
        line = lambda j, b=beta: sum((F.col(t) * float(v) for t, v in zip(terms, b[:, j], strict=True)), F.lit(0.0))
        guess_y, guess_d = F.when(at, line(0)).otherwise(guess_y), F.when(at, line(1)).otherwise(guess_d)
    left = rows.select((F.col("_y") - guess_y).alias("y"), (F.col("_d") - guess_d).alias("d"), F.col("_d").alias("dose"))
    y, d = F.col("y"), F.col("d")
    got = left.agg(F.count("*").alias("n"), F.sum(d * d).alias("dd"), F.sum(d * y).alias("dy"), F.sum(d * d * y * y).alias("ddyy"), F.sum(d * d * d * y).alias("dddy"), F.sum(d * d * d * d).alias("dddd"), F.var_pop("dose").alias("spread")).first()
    theta = got.dy / got.dd
    n = got.n
    spread = got.ddyy - 2 * theta * got.dddy + theta * theta * got.dddd
    se = math.sqrt(max(spread, 0.0)) / got.dd
    return {"theta": theta, "std_error": se, "low": theta - 1.96 * se, "high": theta + 1.96 * se, "p_value": _p(theta / se) if se > 0 else 1.0, "n": n, "first_stage_r2": 1 - got.dd / (n * got.spread) if got.spread else float("nan"), "dose_sd": math.sqrt(got.spread or 0.0)}


@registry.register("dml_report")
def dml_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of ten points of rainfall departure on the price, in per cent, over all commodities' districts."""
    over = "OVER (PARTITION BY commodity, state, district ORDER BY year, month)"
    rows = views.run(spark, sf_dir, f"SELECT commodity, state, district, year, month, ln(avg_price) AS y, departure_pct AS d, LAG(departure_pct) {over} AS lag_dep, LAG(ln(avg_price)) {over} AS lag_price, sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos, CAST(year AS DOUBLE) AS yr FROM panel WHERE n >= 1 AND avg_price > 0")
    key = F.concat_ws("/", "commodity", "state", "district", "year", "month")
    got = double_ml(rows.filter("lag_dep IS NOT NULL"), "y", "d", ["lag_dep", "lag_price", "month_sin", "month_cos", "yr"], key)
    schema = "n long, theta double, std_error double, p_value double, first_stage_r2 double, effect_10pp double, effect_low double, effect_high double"
    if got is None:
        return spark.createDataFrame([], schema)
    share = lambda x: round(100 * (math.exp(10 * x) - 1), 4)
    row = (got["n"], round(got["theta"], 6), round(got["std_error"], 6), round(got["p_value"], 4), round(got["first_stage_r2"], 4), share(got["theta"]), share(got["low"]), share(got["high"]))
    return spark.createDataFrame([row], schema)


def boosted_dml(rows: DataFrame, group: str, outcome: str, dose: str, controls: list[str], key: Column, folds: int = 2, rounds: int = 120, depth: int = 3, step: float = 0.05, least: int = 100, seed: int = 42) -> DataFrame:
    """group and its cross-fitted effect of dose on outcome, with nuisances of boosted trees: one row a group of ``least`` rows and more.

    Fold by fold, outcome and dose of its rows are predicted by trees that saw the other folds only, over all
    groups at once: on the controls, the group, which a tree splits like any category, and its mean outcome and dose in those folds.  The effect, its error and
    the first stage's fit are sums of residual products by group.  Rows with a null are left out; groups without variation of the dose have no row.
    """
    names = [f"_x{k}" for k in range(len(controls))]
    cells = [F.col(outcome).cast("double").alias("_y"), F.col(dose).cast("double").alias("_d"), *[F.col(c).cast("double").alias(x) for c, x in zip(controls, names, strict=True)]]
    given = rows.select(F.col(group).alias("_g"), *cells, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int").alias("_fold"))
    given = keep(given.dropna(subset=["_y", "_d", *names]).withColumn("_name", F.coalesce(F.col("_g").cast("string"), F.lit("\0"))), "nuisance")
    if given.isEmpty():
        folds = 0
    else:
        indexer = StringIndexer(inputCol="_name", outputCol="_group", stringOrderType="alphabetAsc").fit(given)
        bins = max(32, len(indexer.labels) + 1)
    parts = []
    for fold in range(folds):
        seen, own = given.filter(F.col("_fold") != fold), given.filter(F.col("_fold") == fold)
        middle = seen.agg(F.avg("_y").alias("y"), F.avg("_d").alias("d")).first()
        if middle.y is None:
            continue
        means = keep(seen.groupBy("_g").agg(F.avg("_y").alias("_my"), F.avg("_d").alias("_md")), "means")

        def placed(part: DataFrame, means: DataFrame = means, middle=middle) -> DataFrame:
            joined = part.alias("l").join(means.alias("m"), F.col("l._g").eqNullSafe(F.col("m._g")), "left").select("l.*", F.coalesce("_my", F.lit(middle.y)).alias("_my"), F.coalesce("_md", F.lit(middle.d)).alias("_md"))
            return VectorAssembler(inputCols=[*names, "_my", "_md", "_group"], outputCol="_in").transform(indexer.transform(joined))

        train, left = keep(placed(seen), "train"), placed(own)
        for target, guess in (("_y", "_guess_y"), ("_d", "_guess_d")):
            trees = GBTRegressor(featuresCol="_in", labelCol=target, predictionCol=guess, maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=20, maxBins=bins, seed=seed)
            left = trees.fit(train).transform(left)
        parts.append(left.select("_g", (F.col("_y") - F.col("_guess_y")).alias("y"), (F.col("_d") - F.col("_guess_d")).alias("d"), F.col("_d").alias("dose")))
    if not parts:
        return rows.sparkSession.createDataFrame([], given.select(F.col("_g").alias(group)).schema.add("n", "long"))
    y, d = F.col("y"), F.col("d")
    left = functools.reduce(DataFrame.unionByName, parts)
    sums = left.groupBy(F.col("_g").alias(group)).agg(F.count("*").alias("n"), F.sum(d * d).alias("dd"), F.sum(d * y).alias("dy"), F.sum(d * d * y * y).alias("ddyy"), F.sum(d * d * d * y).alias("dddy"), F.sum(d * d * d * d).alias("dddd"), F.var_pop("dose").alias("spread"))
    sums = sums.filter((F.col("n") >= least) & (F.col("dd") > 0) & (F.col("spread") > 0)).withColumn("theta", F.col("dy") / F.col("dd"))
    error = F.sqrt(F.greatest(F.lit(0.0), F.expr("ddyy - 2 * theta * dddy + theta * theta * dddd"))) / F.col("dd")
    shown = sums.withColumn("std_error", error).withColumns({"low": F.expr("theta - 1.96 * std_error"), "high": F.expr("theta + 1.96 * std_error"), "z": F.expr("theta / std_error")})
    return shown.select(group, "n", "theta", "std_error", "low", "high", two_sided(F.col("z")).alias("p_value"), F.expr("1 - dd / (n * spread)").alias("first_stage_r2"), F.expr("sqrt(spread)").alias("dose_sd"))


#: A published rational approximation of the normal distribution's tail (absolute error below 7.5e-8).
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def two_sided(z: Column) -> Column:
    """Share of a normal variable beyond z on either side."""
    size = F.abs(z)
    t = 1 / (1 + 0.2316419 * size)
    total = F.lit(0.0)
    for c in reversed(_TAIL):
        total = (total + c) * t
    return F.least(F.lit(1.0), 2 * total * F.exp(-size * size / 2) / math.sqrt(2 * math.pi))


def _dml_panel(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """District months of at least ``least`` rows with log price, its lag, its deviation over three months, and the departure."""
    over = "OVER (PARTITION BY commodity, state, district ORDER BY year, month"
    return views.run(spark, sf_dir, f"SELECT commodity, state, district, year, month, ln(greatest(avg_price, 1e-6)) AS y, departure_pct AS d, LAG(ln(greatest(avg_price, 1e-6))) {over}) AS lag_price, CASE WHEN COUNT(*) {over} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 THEN STDDEV_SAMP(ln(greatest(avg_price, 1e-6))) {over} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS price_vol, sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos, CAST(year AS DOUBLE) AS yr FROM panel WHERE n >= {least}")


@registry.register("dml_by_commodity")
def dml_by_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of ten points of rainfall departure on each commodity's price, in per cent.

    The panel takes months of one price and more, since the given tables have few a month; the rule's own least is three.
    """
    key = F.concat_ws("/", "commodity", "state", "district", "year", "month")
    got = boosted_dml(_dml_panel(spark, sf_dir, 1), "commodity", "y", "d", ["lag_price", "price_vol", "month_sin", "month_cos", "yr"], key, rounds=20, step=0.2)
    share = lambda c: F.round(100 * (F.exp(10 * F.col(c)) - 1), 4)
    return got.select("commodity", "n", F.round("theta", 6).alias("theta"), F.round("std_error", 6).alias("std_error"), F.round("p_value", 4).alias("p_value"), F.round("first_stage_r2", 4).alias("first_stage_r2"), share("theta").alias("effect_10pp"), share("low").alias("effect_low"), share("high").alias("effect_high"))
