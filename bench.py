"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Times include planning, execution and the fetch of the result; the warm-up run is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scintlake.plans import load  # noqa: E402
from scintlake.session import local_session  # noqa: E402

HEADLINE = ["event_totals", "gain_collapse", "prev_muon_asof", "followups", "n_after", "recovery_table", "density_counts",
            "pulses", "baseline", "group_mode", "event_time", "q0_calib", "light_yield", "charge_energy", "localise", "n200"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    queries = load().QUERIES
    out = {}
    for n in HEADLINE:
        queries[n](spark, sf).limit(1).collect()       # warm up classes and generated code
        t = time.perf_counter()
        # the result is produced in full and dropped at the sink
        queries[n](spark, sf).write.format("noop").mode("overwrite").save()
        out[n] = round(time.perf_counter() - t, 3)
    li, ev, wf = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("lineitem", "events", "embeddings"))
    rates = {"hits_per_s_event_totals": round(li / out["event_totals"]), "hits_per_s_gain_collapse": round(li / out["gain_collapse"]),
             "hits_per_s_density_counts": round(li / out["density_counts"]), "events_per_s_previous_tag": round(ev / out["prev_muon_asof"]),
             "waveforms_per_s_pulses": round(wf / out["pulses"])}
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "rates": rates}))


if __name__ == "__main__":
    main()
