"""Time the headline queries; prints one JSON line.

Each query runs once, to the end of its result, in one session. A small query that is not
counted comes first, so that starting the session is not timed.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from marginalia.plans.queries import QUERIES

HEADLINE = ["highlight_in_context", "section_summary", "stroke_clusters", "crop_numbering",
            "outline_preorder", "highlight_text_from_glyphs", "reading_order",
            "annotation_digest", "filtered_digest_with_images", "corpus_export"]


def run(spark: SparkSession, name: str, folder: str) -> None:
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("marginalia-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "document_totals", folder)
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(spark, name, folder)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total time of the headline queries",
                      "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
