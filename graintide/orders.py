"""Audits, features, breakdowns and drift of retail orders, as functions of DataFrames."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graintide import ranks
from graintide.shared import keep

#: Profit and loss that are taken where too few orders are known.
PROFIT, LOSS = 50.0, -50.0


def audit(df: DataFrame, key: Sequence[str], profit: str = "profit") -> DataFrame:
    """(measure, column, n): rows, full duplicates, rows whose key stood before, losses, and the missing cells of every column."""
    kinds = dict(df.dtypes)
    missing = [F.count_if(F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)]
    sums = df.agg(F.count("*").alias("rows"), F.count_if(F.col(profit) < 0).alias("losses"), *missing)
    line = lambda measure, column, n: F.struct(F.lit(measure).alias("measure"), F.lit(column).cast("string").alias("column"), F.col(n).cast("long").alias("n"))
    cells = F.array(line("rows", None, "rows"), line("losses", profit, "losses"), *[line("missing", c, f"_{i}") for i, c in enumerate(df.columns)])
    again = lambda columns, measure: df.groupBy(*columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(measure).alias("measure"), F.lit(None).cast("string").alias("column"), "n")
    parts = [sums.select(F.explode(cells).alias("c")).select("c.*"), again(df.columns, "full duplicates"), again(key, "key duplicates")]
    return functools.reduce(DataFrame.unionByName, parts)


def features(orders: DataFrame) -> DataFrame:
    """orders with margin, discount tier, calendar parts, loss flag, log sales and delay category.

    orders: sales, profit, discount, order_date, ship_date.  A margin of no sales is null.
    """
    tier = F.when(F.col("discount") == 0, "0%").when(F.col("discount") <= 0.2, "1-20%").when(F.col("discount") <= 0.4, "21-40%").when(F.col("discount").isNotNull(), "41%+")
    delay = F.date_diff("ship_date", "order_date")
    return orders.withColumns({
        "profit_margin": F.col("profit") / F.nullif("sales", F.lit(0.0)) * 100,
        "discount_tier": tier,
        "order_month": F.month("order_date"),
        "order_year": F.year("order_date"),
        "order_quarter": F.quarter("order_date"),
        "order_month_name": F.date_format("order_date", "MMM"),
        "order_year_month": F.date_format("order_date", "yyyy-MM"),
        "is_loss": (F.col("profit") < 0).cast("int"),
        "log_sales": F.log1p("sales"),
        "shipping_delay_cat": F.when(delay <= 2, "Fast").when(delay <= 5, "Normal").when(delay.isNotNull(), "Slow"),
    })


#: Dimensions of ``breakdown``, each a column or an expression over the orders.
DIMENSIONS = {"category": "category", "sub_category": "sub_category", "region": "region", "segment": "segment", "ship_mode": "ship_mode", "month": "date_format(order_date, 'yyyy-MM')"}


def breakdown(orders: DataFrame, dimensions: dict[str, str] = DIMENSIONS) -> DataFrame:
    """One row a value of each dimension, and one over all: rows, sales, profit, margin, share, delay, place, note.

    One scan and one shuffle: each row is dealt to the grouping sets and summed where it is.
    ``place`` ranks by sales, ties by value; notes are loss making, and of months peak or lowest.
    """
    names = list(dimensions)
    rows = orders.select(*[F.expr(e).cast("string").alias(n) for n, e in dimensions.items()], "sales", "profit", F.date_diff("ship_date", "order_date").alias("delay"))
    at = [F.col(n) for n in names]
    sums = rows.groupingSets([[c] for c in at] + [[]], *at).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.avg("delay").alias("delay_days"))
    full = (1 << len(names)) - 1
    which = functools.reduce(lambda c, i: c.when(F.col("g") == full - (1 << (len(names) - 1 - i)), names[i]), range(len(names)), F)
    sums = sums.select(F.coalesce(which, F.lit("all")).alias("dimension"), F.coalesce(*names).alias("value"), "n", "sales", "profit", "delay_days")
    w = Window.partitionBy("dimension")
    ranked = sums.withColumns({
        "margin_pct": F.col("profit") / F.nullif("sales", F.lit(0.0)) * 100,
        "share_pct": F.col("sales") / F.nullif(F.sum("sales").over(w), F.lit(0.0)) * 100,
        "place": F.row_number().over(w.orderBy(F.desc("sales"), "value")).cast("long"),
        "_last": F.count("*").over(w),
    })
    month = F.col("dimension") == "month"
    note = F.when(month & (F.col("place") == 1), "peak").when(month & (F.col("place") == F.col("_last")), "lowest").when(~month & (F.col("profit") < 0), "loss making")
    return ranked.withColumn("note", note).drop("_last")


def distinct_orders(orders: DataFrame, column: str = "category") -> DataFrame:
    """(value, n_orders): orders with a line of each value, and of any (null); lines of one order and value count once."""
    pairs = orders.select(column, "order_id").distinct()
    own = pairs.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_orders"))
    return own.filter("value IS NOT NULL").unionByName(pairs.select("order_id").distinct().agg(F.count("*").alias("n_orders")).select(F.lit(None).cast("string").alias("value"), "n_orders"))


def segment_profits(orders: DataFrame, least: int = 5) -> DataFrame:
    """Mean profit of the profitable and mean loss of the others for each (category, sub_category, region, segment).

    Fewer than ``least`` orders take those of (category, region), fewer there the fixed values with
    n = 0; ``basis`` names which.  Orders are summed once: the wider groups add up the narrower.
    """
    key, wide = ["category", "sub_category", "region", "segment"], ["category", "region"]
    good, bad = F.col("profit") >= 0, F.col("profit") < 0
    own = orders.groupBy(*key).agg(F.count("profit").alias("n"), F.sum(F.when(good, F.col("profit"))).alias("gain"), F.count_if(good).alias("n_gain"), F.sum(F.when(bad, F.col("profit"))).alias("loss"), F.count_if(bad).alias("n_loss"))
    cells = ("n", "gain", "n_gain", "loss", "n_loss")
    above = Window.partitionBy(*wide)
    own = own.withColumns({f"w_{c}": F.sum(c).over(above) for c in cells})
    basis = F.when(F.col("n") >= least, "segment").when(F.col("w_n") >= least, "category and region").otherwise("default")
    pick = lambda c: F.when(F.col("basis") == "segment", F.col(c)).when(F.col("basis") == "category and region", F.col(f"w_{c}"))
    mean = lambda total, count, default: F.coalesce(pick(total) / F.nullif(pick(count), F.lit(0)), F.lit(default))
    return own.withColumn("basis", basis).select(*key, "basis", F.coalesce(pick("n"), F.lit(0)).alias("n_used"), mean("gain", "n_gain", PROFIT).alias("gain"), mean("loss", "n_loss", LOSS).alias("loss"))


def monthly_sales(orders: DataFrame, value: str = "sales", held_out: int = 6) -> DataFrame:
    """(month, y, part): sums by month; months after the greatest less ``held_out`` are the test part."""
    sums = orders.filter("order_date IS NOT NULL").groupBy(F.trunc("order_date", "month").alias("month")).agg(F.sum(value).alias("y"))
    edge = F.add_months(F.max("month").over(Window.partitionBy()), -held_out)
    return sums.withColumn("part", F.when(F.col("month") > edge, "test").otherwise("train"))


def stability(rows: DataFrame, recent: Column, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, n_bins, psi) of numeric columns: older rows (not ``recent``) against recent ones.

    A column of fewer than ``bins`` older values has one bin a value, else bins between its exact
    percentiles; the last bin is open, values below the first are in none.  Shares are at least 0.001.
    A column without values on either side has no row.
    """
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    x = keep(rows.select(recent.alias("recent"), *columns).selectExpr("recent", f"stack({len(columns)}, {stack}) AS (feature, x)").filter("x IS NOT NULL AND NOT isnan(x)"), "features")
    old = x.filter("NOT recent")
    # a rough count tells columns of few values, whose values alone are then gathered
    rough = [r["feature"] for r in old.groupBy("feature").agg(F.approx_count_distinct("x", 0.02).alias("n")).filter(F.col("n") < 4 * bins).collect()]  # one row a column at most
    values = old.filter(F.col("feature").isin(rough)).groupBy("feature", "x").count().groupBy("feature").agg(F.sort_array(F.collect_list("x")).alias("few"))
    shares = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = ranks.quantiles(old, ["feature"], "x", shares).select("feature", F.array_sort(F.array_distinct(F.array(*shares))).alias("quantiles"))
    edges = edges.join(values, "feature", "left").select("feature", F.when(F.size("few") < bins, F.col("few")).otherwise(F.col("quantiles")).alias("edges"))
    edges = keep(edges, "edges")  # one row a column
    bin_of = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    counts = x.join(F.broadcast(edges), "feature").groupBy("feature", "edges", bin_of.alias("bin")).agg(F.count_if(~F.col("recent")).alias("k0"), F.count_if("recent").alias("k1"))
    w = Window.partitionBy("feature")
    counts = counts.withColumns({"n0": F.sum("k0").over(w), "n1": F.sum("k1").over(w)}).filter("n0 > 0 AND n1 > 0")
    held = F.map_from_entries(F.collect_list(F.struct("bin", F.struct((F.col("k0") / F.col("n0")).alias("p"), (F.col("k1") / F.col("n1")).alias("q")))))
    by_feature = counts.groupBy("feature", "edges").agg(held.alias("held"))
    share = lambda i, side: F.greatest(F.lit(0.001), F.coalesce(F.try_element_at(F.col("held"), i)[side], F.lit(0.0)))
    term = lambda i: (share(i, "p") - share(i, "q")) * F.ln(share(i, "p") / share(i, "q"))
    psi = F.aggregate(F.sequence(F.lit(1), F.size("edges")), F.lit(0.0), lambda total, i: total + term(i))
    return by_feature.select("feature", F.size("edges").alias("n_bins"), psi.alias("psi"))


def request_report(log: DataFrame, width: float = 10.0, newest: int = 20) -> DataFrame:
    """(section, label, n, latency): totals, by endpoint, by hour, a histogram of latency, and the newest requests.

    log: request_id, at, endpoint, latency.  The four summaries are sums of one pass; ``latency`` is a
    mean there and the request's own in the newest section, whose ``n`` is its place.
    """
    cells = log.select("endpoint", F.date_format(F.date_trunc("hour", "at"), "yyyy-MM-dd HH:00").alias("hour"), (F.floor(F.col("latency") / width) * width).alias("bucket"), "latency")
    at = [F.col(c) for c in ("endpoint", "hour", "bucket")]
    sums = cells.groupingSets([[c] for c in at] + [[]], *at).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("latency").alias("latency"))
    section = F.when(F.col("g") == 3, "endpoint").when(F.col("g") == 5, "hour").when(F.col("g") == 6, "latency").otherwise("total")
    label = F.when(F.col("g") == 3, F.col("endpoint")).when(F.col("g") == 5, F.col("hour")).when(F.col("g") == 6, F.col("bucket").cast("int").cast("string"))
    last = log.orderBy(F.desc("at"), F.desc("request_id")).limit(newest)
    place = F.row_number().over(Window.orderBy(F.desc("at"), F.desc("request_id"))).cast("long")
    return sums.select(section.alias("section"), label.alias("label"), "n", "latency").unionByName(last.select(F.lit("newest").alias("section"), F.col("request_id").cast("string").alias("label"), place.alias("n"), "latency"))
