"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout.

Every query is written to the no-op sink (all rows and columns are computed, none is collected).
The time of a query is its second run: the first one warms the JVM. Rates are rows or bytes of
input over that time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clipledger.bindings import load, registry  # noqa: E402
from clipledger.session import get_session  # noqa: E402

HEADLINE = [
    "w03_chain_breaks", "j08_key_validity", "g01_audit", "g05_export", "w06_settle_gate", "a02_tip_event", "j05_lock_crosscheck",
    "g02_ingest", "j01_entries_inventory", "p13_strongest_hash", "j10_manifest_inner", "u04_collisions", "a10_content_digest",
    "j09_artifact_integrity", "j13_path_remap", "j11_trust_manifest", "j04_nearest_manifest", "p19_name_scores", "j14_fuzzy_match",
    "j12_colour_agreement", "u02_settle_stream", "u03_content_once",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry().queries
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    events = load(spark, sf_dir, "events").count()
    entries = load(spark, sf_dir, "lineitem").count()
    content = load(spark, sf_dir, "documents").selectExpr("sum(octet_length(text))").first()[0]
    rates = {
        "ledger_events_per_s": round(events / times["w03_chain_breaks"]),
        "audit_events_per_s": round(events / times["g01_audit"]),
        "ingest_entries_per_s": round(entries / times["g02_ingest"]),
        "digest_mb_per_s": round(content / 1e6 / times["a10_content_digest"], 1),
        "stream_rows_per_s": round(events / times["u02_settle_stream"]),
    }
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates": rates,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
