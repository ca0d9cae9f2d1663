"""A polite page source for Structured Streaming: seeds in lanes, a delay and a bound of requests a host, a stop.

``plan_crawl`` writes a frontier of URLs as lanes: a host's URLs are in one lane, and
a lane takes hosts in turn.  The source ``pages`` reads a batch of every lane at a
time: one task a lane, ``per_host`` requests at most to one host at once and
``delay`` seconds between two, ``lanes * per_host`` at once in all.  The offset is
how far each lane has come, so a restart goes on where the last finished batch
ended; nothing moves once ``stop`` seconds have passed since the crawl began.

The driver holds a number a lane.  What asks the network is a function that tasks
import by name: ``fetcher`` is ``module:factory``, and ``factory(options, urls)``
gives a function of a URL that returns its HTML, or None.
"""

from __future__ import annotations

import importlib
import queue
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship

# Seconds between two requests to a host, requests at once in all and to a host, and seconds until a crawl stops.
DELAY, AT_ONCE, PER_HOST, STOP = 5.5, 8, 4, 3600.0
#: Turns of a batch, in each of which a host has one URL at most; and parts that a host's URLs are numbered in.
BATCH, PARTS = 64, 64
#: A batch that took less than so many seconds is followed by one of twice as many turns, up to a bound of what a task holds.
QUICK, MOST_TURNS = 20.0, 16_384


def host(url: Column) -> Column:
    """The host of a URL column, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def plan_crawl(seeds: DataFrame, path: str, lanes: int = AT_ONCE // PER_HOST) -> None:
    """Writes the seeds (url), each once, as a frontier: urls (lane, turn, host, url), sorted by lane and turn, and the turns of each lane.

    A host has at most one URL a turn.  Its URLs are numbered in PARTS parts by a
    hash, so that a host with most of the URLs is many tasks' work.
    """
    rows = seeds.where("url <> ''").select("url").distinct().withColumn("host", host(F.col("url"))).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(PARTS)))
    place = F.row_number().over(Window.partitionBy("host", "part").orderBy("url")) - 1
    dealt = rows.select(F.pmod(F.hash("host"), F.lit(lanes)).alias("lane"), (place * PARTS + F.col("part")).alias("turn"), "host", "url")
    dealt.repartitionByRange("lane", "turn", "host").sortWithinPartitions("lane", "turn", "host").write.partitionBy("lane").parquet(f"{path}/urls")
    spark = seeds.sparkSession
    written = spark.read.schema("turn long, lane int").parquet(f"{path}/urls")
    written.groupBy("lane").agg((F.max("turn") + 1).alias("turns")).coalesce(1).write.parquet(f"{path}/lanes")


def _dataset(path: str):
    from pyarrow import dataset, fs

    system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return dataset.dataset(base, filesystem=system, format="parquet", partitioning="hive")


class Lane(InputPartition):
    def __init__(self, lane: int, start: int, end: int):
        self.lane, self.start, self.end = lane, start, end


def paced(urls: list[tuple[str, str]], fetch: Callable[[str], str | None], delay: float, per_host: int, clock=time.monotonic, sleep=time.sleep) -> Iterator[tuple]:
    """(url, host, html) of (host, url) pairs, as they come: ``per_host`` requests at once to a host, a new one ``delay`` seconds after the last began."""
    hosts: dict[str, list[str]] = {}
    for name, url in urls:
        hosts.setdefault(name, []).append(url)
    done: queue.Queue = queue.Queue()

    def serve(name: str) -> None:
        free, running = threading.Semaphore(per_host), []

        def ask(url: str) -> None:
            try:
                done.put((url, name, fetch(url)))
            except Exception:  # a page that fails is left out, as one that isn't there
                done.put((url, name, None))
            finally:
                free.release()

        for url in hosts[name]:
            free.acquire()
            begun = clock()
            running.append(threading.Thread(target=ask, args=(url,)))
            running[-1].start()
            sleep(max(0.0, begun + delay - clock()))

    waiting = queue.Queue()
    for name in hosts:
        waiting.put(name)

    def work() -> None:
        while True:
            try:
                serve(waiting.get_nowait())
            except queue.Empty:
                return

    for _ in range(min(per_host, len(hosts))):
        threading.Thread(target=work, daemon=True).start()
    for _ in urls:
        yield done.get()


class PagesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.name, self.options = options["path"], options["fetcher"], dict(options)
        self.delay, self.per_host = float(options.get("delay", DELAY)), int(options.get("per_host", PER_HOST))
        self.batch, self.stop = int(options.get("batch", BATCH)), float(options.get("stop", STOP))
        self.last: dict | None = None
        self.planned: float | None = None

    def _ends(self) -> dict[str, int]:
        """Turns of each lane."""
        return {str(r["lane"]): r["turns"] for r in _dataset(f"{self.path}/lanes").to_table().to_pylist()}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"begun": time.time(), "lanes": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        """A batch further in every lane, from the last batch that was planned; the number of batches grows with a crawl's time, not with its turns."""
        last, now = self.last or self.initialOffset(), time.time()
        if now - last["begun"] >= self.stop:
            return last
        if self.planned is not None and self.delay * self.batch < QUICK and now - self.planned < QUICK:
            self.batch = max(self.batch, min(2 * self.batch, MOST_TURNS))
        self.planned = now
        self.last = {"begun": last["begun"], "lanes": {k: min(last["lanes"].get(k, 0) + self.batch, n) for k, n in self._ends().items()}}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        self.last = self.last or end  # after a restart: the offset that the checkpoint has
        spans = [(int(k), start["lanes"].get(k, 0), n) for k, n in end["lanes"].items()]
        return [Lane(k, a, b) for k, a, b in spans if b > a]

    def read(self, partition: Lane) -> Iterator[tuple]:
        from pyarrow import dataset

        turn = dataset.field("turn")
        own = (dataset.field("lane") == partition.lane) & (turn >= partition.start) & (turn < partition.end)
        rows = _dataset(f"{self.path}/urls").to_table(columns=["turn", "host", "url"], filter=own).sort_by([("turn", "ascending"), ("host", "ascending")]).to_pylist()
        module, _, name = self.name.partition(":")
        fetch = getattr(importlib.import_module(module), name)(self.options, [r["url"] for r in rows])
        if partition.start:
            time.sleep(self.delay)  # the batch before may just have asked the same hosts
        for url, own, html in paced([(r["host"], r["url"]) for r in rows], fetch, self.delay, self.per_host):
            if html is not None:
                yield url, own, html

    def commit(self, end: dict) -> None:
        pass


class Pages(DataSource):
    """``spark.readStream.format("pages").option("path", frontier).option("fetcher", "module:factory")``: url, host, html."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, host string, html string"

    def streamReader(self, schema) -> PagesReader:  # noqa: N802
        return PagesReader(self.options)


def read_pages(spark: SparkSession, frontier: str, fetcher: str, **options) -> DataFrame:
    """A stream of the pages of a planned crawl; options: delay, per_host, batch, stop, and what the fetcher takes."""
    ship(spark)
    spark.dataSource.register(Pages)
    reader = spark.readStream.format("pages").option("fetcher", fetcher)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(frontier)


def from_parquet(options: dict[str, str], urls: list[str]) -> Callable[[str], str | None]:
    """A fetcher of pages (url, html) that Spark wrote to the folder ``source``; stands for the network in tests."""
    from pyarrow import dataset

    rows = _dataset(options["source"]).to_table(columns=["url", "html"], filter=dataset.field("url").isin(urls)).to_pylist()
    found: dict[str, str] = {}
    for r in rows:
        if r["html"] is not None and (r["url"] not in found or r["html"] < found[r["url"]]):
            found[r["url"]] = r["html"]
    return found.get
