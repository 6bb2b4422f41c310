"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "cfar_ca_wrap", "cfar_os", "cfar_supplier_profile", "cfar_map_2d", "dual_axis_hits", "grouped_peaks_list", "local_peaks_with_neighbor",
    "asof_nearest", "due_frames", "fused_latest", "playback_timeline", "frame_drops", "rolling_rate", "latency_summary", "recording_summary",
    "polar_points", "log_scaled_map", "filtered_boxes", "filter_scorecard",
    "range_spectrum", "doppler_spectrum", "capon_point_cloud", "beamformed_point_cloud", "peaks_with_variance", "filter_size_sweep", "ambiguity_batched",
    "object_clusters", "point_clusters", "predicted_tracks", "assembled_frames", "packet_gaps", "tlv_points",
]


def main() -> None:
    from rangelake.plans import catalog
    from rangelake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if only:
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
