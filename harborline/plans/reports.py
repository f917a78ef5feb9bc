"""Composed table reports: what an uploaded table is answered with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from harborline.operators import profile as P
from harborline.session import materialize

MIN_ROWS_SHOWN = 100


def dashboard_bundle(df: DataFrame, order_by: Sequence[str], max_rows: int = 1000) -> dict[str, DataFrame]:
    """main (evenly thinned to what a chart can show), kpis over all rows, and the fields of both."""
    whole = materialize(P.default_main(df, order_by))
    main = P.uniform_downsample(whole, max(MIN_ROWS_SHOWN, max_rows), ["pos"])
    kpis = P.kpis(whole, "metric", ["pos"])
    fields = [("main", "t", "datetime", "time"), ("main", "metric", "number", "measure"), ("main", "category", "category", "dimension"), ("main", "id", "string", "id")]
    fields += [("kpis", c, "number", "probability" if c == "risk" else "measure") for c in kpis.columns]
    schema = df.sparkSession.createDataFrame(fields, "table_name string, column_name string, type string, role string")
    return {"main": main, "kpis": kpis, "schema": schema}


def table_report(df: DataFrame, order_by: Sequence[str]) -> dict[str, DataFrame]:
    """Shape, number and value profiles, quality, KPI targets and the dashboard of a table; each is one aggregation."""
    return {
        "shape": P.schema_summary(df),
        "numbers": P.numeric_profile(df),
        "values": P.top_values(df) if P.text_columns(df) else P.schema_summary(df).limit(0),
        "quality": P.quality(df),
        "targets": P.kpi_targets(df, order_by),
        **dashboard_bundle(df, order_by),
    }
