"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of median seconds."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from bookmark_lake.checks import search as S  # noqa: E402
from bookmark_lake.checks import tables as T  # noqa: E402
from bookmark_lake.functions.text import html_links  # noqa: E402
from bookmark_lake.operators.index import read_index, write_index  # noqa: E402
from bookmark_lake.operators.merge import merge_index  # noqa: E402
from bookmark_lake.operators.route import route  # noqa: E402
from bookmark_lake.operators.search import search  # noqa: E402
from bookmark_lake.plans.ingest import parse_responses, storable  # noqa: E402
from bookmark_lake.session import local_session, work_folder  # noqa: E402
from bookmark_lake.sources.responses import pages_as_responses  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def jobs(spark, sf_dir):
    index_path = work_folder(spark, "bench_index")
    items = S.document_items(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    # the given files are single row groups: dealt out here, as a table of many splits would be
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(spark.sparkContext.defaultParallelism)

    def page_items():
        responses = pages_as_responses(pages, "pocket", "pocket_page")
        sink(storable(parse_responses(responses, kinds=["pocket_page"]).fragments))

    def found(terms):
        return lambda: search(read_index(spark, index_path), terms).collect()

    return {
        "index_build": lambda: write_index(items, index_path, S.SEARCH_FIELDS),
        "search_1_term": found(["and"]),
        "search_3_terms": found(["the", "en", "src1"]),
        "search_fuzzy": found(["retitionign~"]),
        "page_text_enrich": page_items,
        "page_links": lambda: sink(pages.select("page_id", F.explode(html_links("html", "url")))),
        "merge_texts": lambda: sink(merge_index(T.text_fragments(spark, sf_dir))),
        "merge_events": lambda: sink(merge_index(T.event_fragments(spark, sf_dir))),
        "route_pages": lambda: sink(route(T.page_requests(spark, sf_dir), T.PAGE_RULES)),
    }


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name, job in jobs(spark, sf_dir).items():
        times = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            job()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
