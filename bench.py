"""Whole-table runs against runs on a share of the blocks, over one stored block table.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS (best of) may be set.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from blockquorum.operators import baselines  # noqa: E402
from blockquorum.operators.itemsets import candidate_itemsets, local_itemsets, recount_itemsets, vote_itemsets  # noqa: E402
from blockquorum.plans import classify, cluster  # noqa: E402
from blockquorum.runtime import fresh_path  # noqa: E402
from blockquorum.operators.blocks import select_blocks  # noqa: E402
from blockquorum.sources import store, tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
BLOCKS = tables.LINE_BLOCKS
TEST_IDS = [38, 39]
SHARES = {"5%": 2, "10%": 4, "25%": 10}
MINSUP = 0.08


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def itemset_keys(df) -> set[str]:
    return {r.itemset for r in df.select("itemset").collect()}


def main() -> None:
    spark = session()
    begin = time.perf_counter()
    lines_path, baskets_path = fresh_path(spark, "lines"), fresh_path(spark, "baskets")
    store.write_blocks(tables.line_blocks(spark, SF_DIR), lines_path)
    store.write_blocks(tables.baskets(spark, SF_DIR), baskets_path)
    seconds, quality, rows_read = {"write_blocks": time.perf_counter() - begin}, {}, {}
    lines, baskets = store.read_blocks(spark, lines_path), store.read_blocks(spark, baskets_path)
    total = lines.count()
    real = tables.real_centres(lines, "lines", 4).cache()
    n_baskets = baskets.count()

    def timed(name, run, read):
        best, result = None, None
        for _ in range(RUNS):
            begin = time.perf_counter()
            result = run()
            spent = time.perf_counter() - begin
            best = spent if best is None else min(best, spent)
        seconds[name], quality[name], rows_read[name] = round(best, 3), result, read

    def acc(df):
        return round(df.first().accuracy, 4)

    for algo in ("DT", "LR", "RF", "SVM"):
        timed(f"full_{algo}", lambda: acc(baselines.full_classifier(lines, algo)[1]), total)
        for share, n in SHARES.items():
            if algo in ("DT", "LR") or share == "10%":
                timed(
                    f"blocks_{algo}_{share}",
                    lambda: acc(classify.run_ensemble(lines, list(range(n)), TEST_IDS, algo).accuracy()),
                    total * n // BLOCKS,
                )
    for algo in ("kmeans", "bisectingkmeans"):

        def full():
            _, pure, away = cluster.run_full(lines, algo, real)
            return [round(pure.first().purity, 4), round(away.first().distance, 4)]

        def blocks(n):
            run = cluster.run_two_stage(lines, list(range(n)), TEST_IDS, algo, real)
            return [round(run.purity.first().purity, 4), round(run.distance.first().distance, 4)]

        timed(f"full_{algo}", full, total)
        for share, n in SHARES.items():
            if algo == "kmeans" or share == "10%":
                timed(f"blocks_{algo}_{share}", lambda: blocks(n), total * n // BLOCKS)

    timed("full_itemsets", lambda: len(itemset_keys(baselines.full_itemsets(baskets, MINSUP))), n_baskets)
    exact = itemset_keys(baselines.full_itemsets(baskets, MINSUP))

    def hits(found):
        both = len(found & exact)
        return [round(both / max(1, len(found)), 3), round(both / len(exact), 3)]

    for share, n in SHARES.items():
        part = select_blocks(baskets, list(range(n)))
        read = n_baskets * n // BLOCKS
        timed(f"itemset_vote_{share}", lambda: hits(itemset_keys(vote_itemsets(local_itemsets(part, MINSUP, n), n, 0.5))), read)

        def recount():
            candidates = candidate_itemsets(local_itemsets(part, MINSUP, n, min_size=2))
            return hits(itemset_keys(recount_itemsets(part, candidates, MINSUP)))

        timed(f"itemset_recount_{share}", recount, read)
    timed("block_counts", lambda: lines.groupBy("block_id").agg(F.count("*")).count(), total)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "quality": quality,
                "rows_read": rows_read,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
