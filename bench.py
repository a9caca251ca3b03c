"""Headline timings: one JSON line.  BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose the run."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pagemill.plans import Tables, load_all
from pagemill.session import build_session

HEADLINE = (
    "url_filter_set own_claim use_daily use_weekly use_self_heal dash_metrics adm_daily_platform "
    "tbl_merge_changes conv_with_messages doc_fingerprint doc_dedup lang_detect txt_keywords "
    "policy_full parse_pages link_extract meta_enrich chunk_merge_small chunk_documents emb_summary "
    "vec_insert_new ret_topk rank_fuse_sort ret_result stream_use_daily"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    tables = Tables(spark, folder, splits=int(cpus))
    tables.lineitem.groupBy("l_returnflag").count().collect()  # start the executors
    timings: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        registry[name].build(tables).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
