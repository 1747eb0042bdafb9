"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default sf0.1) and BENCH_CPUS (default all cores). Each query's
whole result is produced and thrown away, so no column can be pruned.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402

HEADLINES = [
    "validation_bits", "char_counts", "unigram_bits", "bits_per_byte", "frequency_rank",
    "word_frequency_rank", "assign_byte_codes", "character_vocab_capped", "character_encode",
    "byte_encode", "line_dataset", "codes_joined", "pinyin_numbered", "keys_to_components",
    "pair_counts", "merged_vocab_train", "merged_encode", "repack_encode", "compare_tokenizers",
    "batch_id", "split_exact", "mask_tokens", "encode_task_pair", "pivot_runs", "step_numbers",
    "stop_rule", "stream_char_counts_by_batch", "score_tasks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    wanted = sys.argv[1:] or HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()
    times = {}
    for name in wanted:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
