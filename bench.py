"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harborline.plans import load_all  # noqa: E402
from harborline.plans.registry import QUERIES  # noqa: E402
from harborline.session import build_session, drop_scratch  # noqa: E402

HEADLINE = [
    "A1_schema_summary", "A2_numeric_profile", "A3_top_values", "A5_profile_by", "A7_order_rollup", "A12_linear_forecast", "A13_kpis", "A18_prediction_summary",
    "A19_classification_report", "A20_regression_report", "A28_histogram", "A33_chart_aggregate", "J1_lookup_join", "J2_star_join", "J3_agg_join_back",
    "J4_composite_lookup", "J7_column_overlap_match", "W1_lag_features", "W2_rolling_features", "W4_oof_target_encode", "W9_ema", "T7_cap_rows", "T8_split_assign",
    "U1_content_dedupe", "E8_standard_scale", "E10_robust_scale", "F17_shipment_charge", "F35_word_f1", "R1_upsert_aliases", "R11_build_corpus", "X1_rate_check", "X2_sessions",
    "J9_fuzzy_match", "F45_document_anchors", "F20_intent_category", "J8_blend_and_decide", "J7_missing_columns", "R4_upsert_semantics", "S1_read_delimited", "S1_quoted_breaks", "X1_rate_stream", "X1_rate_check_one_key", "X5_stream_upsert", "A2_profile_from_states", "E14_linear_model",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the executors' threads and the reader.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    drop_scratch(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
