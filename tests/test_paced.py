"""The polite page source: its order, its pace, its stop, and restarts."""

import threading
import time
from collections import defaultdict

from pyspark.sql import functions as F

from searchloom.sources import paced



def test_pace():
    """At most so many requests at once to a host, and a delay between two; hosts don't wait for one another."""
    now, begun, most, running = threading.Lock(), defaultdict(list), defaultdict(int), defaultdict(int)

    def fetch(url):
        host = url.split("/")[0]
        with now:
            begun[host].append(time.monotonic())
            running[host] += 1
            most[host] = max(most[host], running[host])
        time.sleep(0.1)
        with now:
            running[host] -= 1
        if url.endswith("3"):
            raise OSError("gone")
        return url

    urls = [(h, f"{h}/{i}") for i in range(5) for h in ("a", "b", "c")]
    start = time.monotonic()
    got = list(paced.paced(urls, fetch, 0.04, 2))
    took = time.monotonic() - start
    assert sorted(u for u, _, html in got if html) == sorted(u for _, u in urls if not u.endswith("3")) and len(got) == 15
    assert max(most.values()) <= 2 and took < 1.5
    assert all(b - a >= 0.039 for times in begun.values() for a, b in zip(times, times[1:], strict=False))


def test_frontier_takes_hosts_in_turn(spark, tmp_path):
    seeds = spark.createDataFrame([(f"https://big.org/{i}",) for i in range(300)] + [(f"http://s{i}.org/",) for i in range(20)] + [("https://big.org/1",), (None,), ("",)], "url string")
    paced.plan_crawl(seeds, str(tmp_path / "f"))
    rows = spark.read.parquet(str(tmp_path / "f/urls"))
    assert rows.count() == 320 and rows.groupBy("host", "turn").count().where("count > 1").isEmpty()
    assert rows.groupBy("host").agg(F.countDistinct("lane").alias("n")).where("n > 1").isEmpty()


def test_restart_and_stop(spark, tmp_path):
    """A second start goes on where the first ended; nothing is read twice, and nothing after the stop."""
    pages = spark.range(500).select(F.concat(F.lit("https://h"), F.col("id") % 3, F.lit(".org/"), "id").alias("url"), F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("html"))
    pages.write.parquet(str(tmp_path / "site"))
    paced.plan_crawl(pages, str(tmp_path / "f"))

    def run(out, stop=3600):
        stream = paced.read_pages(spark, str(tmp_path / "f"), "searchloom.sources.paced:from_parquet", source=tmp_path / "site", delay=0, batch=64, stop=stop)
        stream.writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"{out}-c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema("url string, host string, html string").parquet(str(tmp_path / out)) if (tmp_path / out).exists() else None

    first = run("out").count()
    assert 0 < first < 450
    for _ in range(8):
        found = run("out")
    assert found.count() == found.select("url").distinct().count() == 450
    stopped = run("none", stop=0)
    assert stopped is None or stopped.count() == 0
