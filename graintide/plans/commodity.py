"""Every commodity's report of six sections; a section that fails says so in its rows and leaves the others as they are."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide import registry, views
from graintide.plans import causal, estimators, forecasting, series, tails  # noqa: F401  (they register the sections' queries)
from graintide.shared import keep

#: Columns of each section, of one row a commodity.
SECTIONS = {
    "conformal": "n_calibration long, half_width double, coverage double",
    "drift": "psi double, psi_verdict string, ks_d double, ks_p double, quality_score double",
    "tail_risk": "var95 double, cvar95 double, evt_var99 double, max_drawdown_pct double",
    "dml": "theta double, p_value double, effect_10pp double",
    "nowcast": "nowcast double, completion_pct double, days_remaining int",
    "spec_curve": "n_estimated long, n_significant long, median_effect double, sign_stable boolean",
}
SILENT = "No section has a result for this commodity."
#: What a section without a row for a commodity says there.
NO_ROW = "too few rows"

Maker = Callable[[], DataFrame]


def isolated(spark: SparkSession, name: str, make: Maker, columns: str) -> tuple[DataFrame, str | None]:
    """A section's rows, computed into the shared folder, and None; or no rows and what went wrong.

    Spark is lazy, so a section fails where its rows are computed: that happens here, and any exception is
    the section's own.  Missing columns and several rows for a commodity are failures too; rows without a commodity are left out.
    """
    shape = f"commodity string, {columns}"
    try:
        fields = spark.createDataFrame([], shape).schema.fields
        rows = keep(make().filter("commodity IS NOT NULL").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]), name)
        if not rows.groupBy("commodity").count().filter("count > 1").isEmpty():
            raise ValueError("several rows for a commodity")
        return rows, None
    except Exception as e:  # a section must not end the report
        logging.getLogger(__name__).warning("section %s failed: %s", name, e)
        line = (str(e).strip().splitlines() or [""])[0]
        return spark.createDataFrame([], shape), f"{type(e).__name__}: {line}"[:300]


def joined(commodities: DataFrame, makers: dict[str, Maker], columns: dict[str, str] = SECTIONS) -> DataFrame:
    """One row a commodity: a struct of each section, null where it has none, and the map ``errors`` from such sections to the reason."""
    out, reasons = commodities.select("commodity").filter("commodity IS NOT NULL").distinct(), []
    for name, make in makers.items():
        rows, error = isolated(commodities.sparkSession, name, make, columns[name])
        shown = [c for c in rows.columns if c != "commodity"]
        out = out.join(rows.select("commodity", F.struct(*shown).alias(name)), "commodity", "left")
        reasons.append(F.when(F.col(name).isNull(), F.struct(F.lit(name).alias("key"), F.lit(error or NO_ROW).alias("value"))))
    return out.withColumn("errors", F.map_from_entries(F.filter(F.array(*reasons), lambda x: x.isNotNull())))


def narrow(report: DataFrame) -> DataFrame:
    """One row a commodity and section: its content as JSON, or its error."""
    names = [c for c in report.columns if c not in ("commodity", "errors")]
    each = F.array(*[F.struct(F.lit(n).alias("section"), F.to_json(F.col(n)).alias("content"), F.try_element_at("errors", F.lit(n)).alias("error")) for n in names])
    return report.select("commodity", F.inline(each))


def headline() -> Column:
    """One line of what the sections say; a part whose figure is missing is left out."""
    notes = [
        ("drift.quality_score", F.format_string("data quality %.0f/100", "drift.quality_score")),
        ("drift.psi_verdict", F.concat(F.lit("price distribution "), F.col("drift.psi_verdict"))),
        ("tail_risk.evt_var99", F.format_string("99%% daily VaR %.1f%%", F.col("tail_risk.evt_var99") * 100)),
        ("dml.p_value", F.format_string("rainfall sensitivity p=%.3f", "dml.p_value")),
        ("nowcast.nowcast", F.concat(F.format_string("month-end nowcast %.0f", "nowcast.nowcast"), F.coalesce(F.when(F.col("nowcast.completion_pct").isNotNull(), F.format_string(" (%.0f%% of month reported)", "nowcast.completion_pct")), F.lit("")))),
        ("spec_curve.median_effect", F.concat(F.format_string("median effect across %d specifications %.0f (", "spec_curve.n_estimated", "spec_curve.median_effect"), F.when(F.col("spec_curve.sign_stable"), "one sign, ").otherwise("both signs, "), F.format_string("%d significant)", "spec_curve.n_significant"))),
    ]
    line = F.concat_ws("; ", *[F.when(F.col(c).isNotNull(), text) for c, text in notes])
    return F.when(line == "", SILENT).otherwise(F.concat(line, F.lit(".")))


def wide(report: DataFrame) -> DataFrame:
    """One row a commodity: every section's columns, the sections with and without a result, and the headline."""
    names = [c for c in report.columns if c not in ("commodity", "errors")]
    failed = F.map_keys("errors")
    return report.select(
        "commodity", *[F.col(f"{n}.{c}").alias(c) for n in names for c in report.schema[n].dataType.names],
        F.concat_ws(",", F.array_except(F.array(*[F.lit(n) for n in names]), failed)).alias("sections_available"), F.concat_ws(",", failed).alias("sections_failed"), headline().alias("headline"),
    )


def makers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Maker]]:
    """The commodities of one directory and their sections; days and panel are computed once for all that read them."""
    prices = views.run(spark, sf_dir, "SELECT * FROM prices")
    given = {"prices": prices, "daily": keep(views.run(spark, sf_dir, "SELECT * FROM daily"), "daily"), "panel": keep(views.run(spark, sf_dir, "SELECT * FROM panel"), "panel")}

    def text(key: str) -> DataFrame:
        return views.over(spark, registry.texts[key][0], given)

    found: dict[str, Maker] = {
        "conformal": lambda: text("split_conformal"),
        "drift": lambda: text("drift_report").join(text("psi").select("commodity", F.col("verdict").alias("psi_verdict")), "commodity", "left"),
        "tail_risk": lambda: text("tail_risk_report"),
        "dml": lambda: causal.dml_by_commodity(spark, sf_dir),
        "nowcast": lambda: series.nowcast_month_end(spark, sf_dir),
        "spec_curve": lambda: text("spec_curve_summary"),
    }
    return prices.select("commodity"), found


@registry.register("commodity_report")
def commodity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sections of every commodity side by side, with what is missing and a headline."""
    return wide(joined(*makers(spark, sf_dir)))


@registry.register("report_sections")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rows a commodity: each section's content or error."""
    return narrow(joined(*makers(spark, sf_dir)))
