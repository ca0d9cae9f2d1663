import json
import uuid

import pytest
from pyspark.sql import functions as F

from searchloom import cli
from searchloom.sources import html, pages as sources
from searchloom.sources.jsonl import DocumentStore, append_items
from searchloom.streaming import crawl


@pytest.fixture
def data(tmp_path):
    for category, name, lines in (
        ("mobile", "a_2024-01-01.jsonl", ['{"url": "u1", "title": "Uno", "content": "gato", "tags": []}', "", "not json", '{"url": "u2", "content": null, "category": "smartphone"}']),
        ("mobile", "b_2024-01-02.jsonl", ['{"url": "u1", "title": "Dos", "content": "perro", "tags": ["x"]}', '{"title": "sin url", "n": 1.5, "b": [true, null]}']),
        ("pc", "a_2024-01-01.jsonl", ['  {"url": "u2", "content": "pc", "author": "Á"}  ']),
    ):
        (tmp_path / category).mkdir(exist_ok=True)
        (tmp_path / category / name).write_text("\n".join(lines), encoding="utf-8")
    return str(tmp_path)


def test_store(spark, data, tmp_path):
    store = DocumentStore.load(spark, data)
    docs = {r.id: r for r in store.documents.collect()}
    assert docs["u1"].title == "Dos" and docs["u1"].tags == ["x"] and docs["u1"].category == "mobile"
    assert docs["u2"].category == "pc" and docs["u2"].content == "pc" and docs["u2"].tags == ["Unknowns"] and docs["u2"].title == ""
    raw = {"title": "sin url", "n": 1.5, "b": [True, None]}
    assert docs[str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(raw, sort_keys=True)))].url == ""
    assert [(r.line_no, r.value) for r in store.malformed.collect()] == [(3, "not json")]
    assert {r.category: r.documents for r in store.by_category().collect()} == {"mobile": 2, "pc": 1}
    assert store.get("nope").count() == 0 and store.in_category("pc").count() == 1 and len(list(store)) == 3
    store.save_snapshot(str(tmp_path / "snap"))
    back = DocumentStore.from_snapshot(spark, str(tmp_path / "snap"))
    assert sorted(map(str, back.documents.collect())) == sorted(map(str, docs.values()))


def test_missing_folder(spark, tmp_path):
    assert DocumentStore.load(spark, str(tmp_path)).documents.count() == 0


def test_sink(spark, tmp_path):
    items = spark.createDataFrame([("u", "ñ", None)], "url string, title string, author string")
    append_items(items, str(tmp_path), "apple_newsroom", F.lit("2024-02-03").cast("date"))
    append_items(items, str(tmp_path), "apple_newsroom", F.lit("2024-02-03").cast("date"))
    files = list((tmp_path / "mobile").rglob("*.json"))
    assert len([f for f in files if f.stat().st_size]) >= 2 and "2024-02-03" in str(files[0])
    assert DocumentStore.load(spark, str(tmp_path)).documents.count() == 1


PAGE = """<html><head><title>T</title><meta property="article:tag" content="Meta"><meta property="og:image" content="i.png">
<meta name="DC.Creator" content=" Ana "><meta property="article:section" content="S"></head><body><script>var a = "<p>no</p>";</script>
<h1> Título &amp; más <b>x</b></h1><time datetime="2024-05-06T00:00:00Z"></time><div class="abstract-title"><a href="/1">a</a></div><a class="x btn-next" href="/2">next</a>
<div class="article-content big"><p>Uno <b>dos</b><p>tres<br>cuatro<ul><li>cinco<ul><li>seis</li></ul></li><li>siete</ul><h2>ocho</h2></div>
<div class="article-tags"><a>Tag</a><a> </a><a>Meta</a></div></body>"""


def test_article():
    found = html.article(PAGE, html.NEWS)
    assert found["title"] == "Título & más" and found["author"] == "Ana" and found["date"] == "2024-05-06T00:00:00Z"
    assert found["content"] == "Uno dos trescuatro cincoseis seis siete ocho"
    assert found["tags"] == ["Meta", "Tag"] and found["section"] == "S" and found["image"] == "i.png"
    assert found["links"] == ["/1"] and found["next_page"] == "/2"
    empty = html.article(None, html.NEWS)
    assert empty["title"] is None and empty["content"] == "" and empty["tags"] == []


def test_references_need_their_semicolon():
    found = html.article('<h1>a &amp;&lt;&#38; b &amp;lt; &ampx; c&amp</h1><a href="?a=1&copy=2&amp;b">n</a>', html.PLAIN)
    assert found["title"] == "a &<& b &lt; &ampx; c&amp" and found["links"] == ["?a=1&copy=2&b"]


def test_traverse_gives_titles_with_cut_references(spark):
    pages = spark.createDataFrame([("https://e.org/1", "<h1>x &amp;&amp</h1>")], "url string, html string")
    assert [r.title for r in sources.traverse(pages.select("url"), sources.from_table(pages), html.PLAIN).collect()] == ["x &&amp"]


def test_items(spark):
    pages = spark.createDataFrame([("u", PAGE), ("v", None)], "url string, html string")
    clock = F.timestamp_seconds(F.lit(0))
    rows = {r.url: r for r in html.crawl_items(html.extract(pages), "pc", "fuente", now=clock).collect()}
    assert rows["u"].metadata.blog_type == "magazine" and rows["u"].category == "pc" and rows["u"].specs == {}
    assert rows["v"].date == "1970-01-01T00:00:00Z" and rows["v"].scraped_at == "1970-01-01T00:00:00"
    with pytest.raises(ValueError, match="name"):
        html.crawl_items(pages, "", "x")


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("", 3), (None, 4), ("b", 5)], "url string, n int").write.parquet(source)
    batch = crawl.unseen(spark.read.parquet(source), ["url"])
    for _ in range(2):  # a restart adds nothing
        crawl.crawl(crawl.read_stream(spark, source), str(tmp_path / "out"), str(tmp_path / "check"), now=F.timestamp_seconds(F.lit(0))).awaitTermination()
    out = spark.read.schema("url string, n int, scraped_at string").json(str(tmp_path / "out"))
    assert sorted(r.url or "" for r in out.collect()) == sorted(r.url or "" for r in batch.collect()) == ["", "", "a", "b"]
    assert {r.scraped_at for r in out.collect()} == {"1970-01-01T00:00:00"}
    seen = spark.createDataFrame([("a",), ("",)], "url string")
    assert sorted(r.n for r in crawl.not_in(spark.read.parquet(source), seen).collect()) == [3, 4, 5]


def test_stream_upsert(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([(1, f"v{i}"), (10 + i, "x")], "doc_id long, x string").coalesce(1).write.mode("append").parquet(source)
    stream = crawl.read_stream(spark, source, 1)
    crawl.upsert_each_batch(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "table/v1")).collect()} == {1, 10, 11}


def test_cli(spark, data, tmp_path, capsys):
    index, model = str(tmp_path / "index"), str(tmp_path / "model")
    assert cli.query(spark, model, lines=[]) == 0 and cli.build(spark, index, model) == 1
    assert cli.index(spark, str(tmp_path / "nothing"), index) == 1
    assert cli.index(spark, data, index) == 0 and cli.build(spark, index, model) == 0
    assert cli.query(spark, model, lines=["", "perro", "quit", "gato"]) == 0
    assert "Dos" in capsys.readouterr().out


def test_cli_auto(spark, data, tmp_path, capsys, monkeypatch):
    """Builds where there is no model, else answers standard input."""
    import io

    index, model = str(tmp_path / "index"), str(tmp_path / "model")
    assert cli.main(["index", data, index]) == 0 and cli.main(["auto", index, model]) == 0
    monkeypatch.setattr(cli.query, "__defaults__", (5, io.StringIO("perro\nexit\n")))
    assert cli.main(["auto", index, model]) == 0 and "Dos" in capsys.readouterr().out
    assert cli.main(["build", str(tmp_path / "none"), model]) == 1


def test_stream_deltas(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(1, f"v{i}"), (10 + i, "x")], "doc_id long, x string").coalesce(1).write.mode("append").parquet(source)
    crawl.upsert_deltas(crawl.read_stream(spark, source, 1), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert len(list((tmp_path / "table").glob("generation=*"))) == 3
    found = {r.doc_id: r.x for r in crawl.load_deltas(spark, str(tmp_path / "table")).collect()}
    assert set(found) == {1, 10, 11, 12}
    crawl.compact_deltas(spark, str(tmp_path / "table"), str(tmp_path / "compact"))
    assert {r.doc_id: r.x for r in crawl.load_deltas(spark, str(tmp_path / "compact")).collect()} == found


def test_stream_index_counts_a_document_once(spark, tmp_path):
    """A document that comes again counts as it came last, even without a token."""
    source, rows = str(tmp_path / "in"), [[("1", "gato gato"), ("2", "perro")], [("1", "gato"), ("2", "")]]
    schema = "id string, content string"
    for batch in rows:
        docs = spark.createDataFrame(batch, schema).select("id", *(F.lit("").alias(c) for c in ("url", "title")), "content", *(F.lit("x").alias(c) for c in ("source", "date", "category")), F.array(F.lit("t")).alias("tags"))
        stream = docs.coalesce(1)
        stream.write.mode("append").parquet(source)
        crawl.index_each_batch(crawl.read_stream(spark, source, 1), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    index = crawl.load_generations(spark, str(tmp_path / "index"))
    assert [tuple(r) for r in index.postings.collect()] == [("gato", "1", 1)] and [r.doc_id for r in index.doc_info.collect()] == ["1"]


def test_seen_log(spark, tmp_path):
    log = str(tmp_path / "log")
    first = crawl.session(spark.createDataFrame([("a", 1), ("a", 1), ("", 2), (None, 3)], "url string, n int"), log)
    assert sorted((r.url or "", r.n) for r in first.collect()) == [("", 2), ("", 3), ("a", 1)]
    second = crawl.session(spark.createDataFrame([("a", 4), ("b", 5)], "url string, n int"), log)
    assert [tuple(r) for r in second.collect()] == [("b", 5)]
    assert sorted(r.url for r in crawl.remembered(spark, log).collect()) == ["a", "b"]


def test_session_keeps_a_keys_least_item(spark, tmp_path):
    rows = [(None, "u")] + [(i, "u") for i in range(400, 0, -1)] + [(7, "v"), (5, None), (6, "")]
    items = spark.createDataFrame(rows, "page_id long, url string").repartition(7)
    found = crawl.session(items, str(tmp_path / "log"))
    assert sorted((r.page_id, r.url or "") for r in found.collect()) == [(1, "u"), (5, ""), (6, ""), (7, "v")]


def test_traverse(spark):
    """Listing, articles and next page; a page is fetched once, and a missing one is left out."""
    link = lambda *urls: "".join(f'<div class="abstract-title"><a href="{u}">x</a></div>' for u in urls)
    pages = [
        ("https://x.org/tag/a", link("/1", "two", "https://x.org/1#top", "mailto:a@b") + '<a class="btn-next" href="?p=2">n</a>'),
        ("https://x.org/1", "<h1>One</h1>" + link("/tag/a")), ("https://x.org/tag/two", "<h1>Two</h1>"), ("https://x.org/tag/a?p=2", link("//y.org/3", "/gone")), ("https://y.org/3", "<h1>Three</h1>"),
        ("https://x.org/unlinked", ""),
    ]
    table = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([("https://x.org/tag/a",), ("https://x.org/tag/a",), (None,)], "url string")
    found = {r.url: (r.depth, r.title) for r in sources.traverse(seeds, sources.from_table(table)).collect()}
    assert found == {"https://x.org/tag/a": (0, None), "https://x.org/1": (1, "One"), "https://x.org/tag/two": (1, "Two"), "https://x.org/tag/a?p=2": (1, None), "https://y.org/3": (2, "Three")}
    assert sources.traverse(seeds.limit(0), sources.from_table(table)).count() == 0


def test_large_files_are_split(spark, tmp_path):
    """Lines keep their order and numbers over a file's splits."""
    (tmp_path / "pc").mkdir()
    lines = [json.dumps({"url": f"u{i % 50}", "title": str(i), "content": "x" * 200}) if i % 97 else "broken" for i in range(2000)]
    (tmp_path / "pc" / "a.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        store = DocumentStore.load(spark, str(tmp_path))
        assert {r.id: r.title for r in store.documents.collect()} == {f"u{i % 50}": str(i) for i in range(2000) if i % 97}
        assert sorted(r.line_no for r in store.malformed.collect()) == [i + 1 for i in range(0, 2000, 97)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_resolve(spark):
    """The examples of RFC 3986, 5.4, for web pages, and a few more."""
    base = "http://a/b/c/d;p?q"
    expected = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": None,
        "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": None, ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
        "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g",
        "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
        "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
        "HTTP://Z.org/A": "http://z.org/A", "mailto:a@b": None, "javascript:f()": None, " /x ": "http://a/x", "https://y.org": "https://y.org", "https://y.org/a/../b": "https://y.org/b", "http:": None,
    }
    rows = [(base, h) for h in expected] + [("https://x.org", "a"), ("https://x.org?q", "?p=2"), ("https://x.org/tag/a", "?p=2"), ("https://x.org/t#f", "u"), ("https://x.org/", None)]
    got = [r.u for r in spark.createDataFrame(rows, "b string, h string").coalesce(1).select(sources.resolve(F.col("b"), F.col("h")).alias("u")).collect()]
    assert dict(zip(expected, got, strict=False)) == expected
    assert got[len(expected) :] == ["https://x.org/a", "https://x.org?p=2", "https://x.org/tag/a?p=2", "https://x.org/u", None]


def test_a_long_listing_is_followed_to_its_end(spark):
    pages = spark.range(1, 131).select(F.concat(F.lit("https://x.org/l?p="), "id").alias("url"), F.concat(F.lit('<a class="btn-next" href="?p='), F.col("id") + 1, F.lit('">n</a>')).alias("html"))
    seeds = spark.createDataFrame([("https://x.org/l?p=125",)], "url string")
    assert sources.traverse(seeds, sources.from_table(pages)).count() == 6
    assert sources.traverse(seeds, sources.from_table(pages), max_depth=2).count() == 3
    twice = spark.createDataFrame([("u", "<h1>b</h1>"), ("u", "<h1>a</h1>")], "url string, html string")
    assert [r.html for r in sources.from_table(twice)(spark.createDataFrame([("u",)], "url string")).collect()] == ["<h1>a</h1>"]


def test_session_streams(spark, tmp_path):
    """State goes on over restarts, a new session begins from the log, and a key's time to live ends."""
    from searchloom.streaming.seen import session_stream

    source, log = str(tmp_path / "in"), str(tmp_path / "log")

    def feed(*urls):
        spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, n int").coalesce(1).write.mode("append").parquet(source)

    def run(out, **options):
        session_stream(crawl.read_stream(spark, source), log, str(tmp_path / out), str(tmp_path / f"{out}-check"), **options).awaitTermination()
        return sorted((r.url or "") for r in spark.read.schema("url string, n int").option("recursiveFileLookup", "true").parquet(str(tmp_path / out)).collect())

    feed("a", "a", "b", None, "")
    assert run("one") == ["", "", "a", "b"]
    feed("b", "c")
    assert run("one") == ["", "", "a", "b", "c"]
    feed("d", "a")
    assert run("two") == ["", "", "d"]
    assert sorted(r.url for r in crawl.remembered(spark, log).distinct().collect()) == ["a", "b", "c", "d"]
    log = str(tmp_path / "short")
    assert run("three", ttl_seconds=0.001) == ["", "", "a", "b", "c", "d"]
    feed("a")
    assert run("three", ttl_seconds=0.001) == ["", "", "a", "a", "b", "c", "d"]


def test_columnar_store(spark, tmp_path):
    """A lookup pushes its equality down, to files that have Bloom filters and are sorted by id; a category is a folder."""
    from pyarrow import parquet

    from searchloom.sources.store import ColumnarStore

    with pytest.raises(FileNotFoundError):
        ColumnarStore.open(spark, str(tmp_path / "none"))
    one = (F.lit(None).cast("string").alias(c) for c in ("author", "date", "scraped_at", "brand", "os", "device_name", "article_type"))
    docs = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("id"), *(F.lit("x").alias(c) for c in ("url", "title", "source", "subcategory")), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("content"), F.array(F.lit("t")).alias("tags"), F.when(F.col("id") % 3 == 0, "pc").otherwise("mobile").alias("category"), *one)
    store = ColumnarStore.write(docs, str(tmp_path / "store"), row_group=100_000)
    found = store.get("d77")
    assert [r.id for r in found.collect()] == ["d77"] and store.get("nothing").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,d77)" in plan and "Exchange" not in plan
    only = store.in_category("pc")
    assert only.count() == 1000 and "PartitionFilters: [isnotnull(category" in only._jdf.queryExecution().executedPlan().toString()
    groups = [parquet.ParquetFile(f).metadata for f in (tmp_path / "store/generations").rglob("*.parquet")]
    spans = [(m.row_group(g).column(0).statistics.min, m.row_group(g).column(0).statistics.max) for m in groups for g in range(m.num_row_groups)]
    assert len(spans) > 10 and sum(a <= "d77" <= b for a, b in spans) <= 4  # of each category's one or two
    assert {r.id for r in store.get_many(spark.createDataFrame([("d1",), ("d1",), ("no",)], "id string")).collect()} == {"d1"}
    assert {r.category: r.documents for r in store.by_category().collect()} == {"pc": 1000, "mobile": 2000}


def test_progress_log(spark, tmp_path):
    from searchloom.streaming.progress import log_progress, progress, totals, wait_for_end

    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for i in range(3):
        spark.range(10 * (i + 1)).coalesce(1).write.mode("append").parquet(source)
    listener = log_progress(spark, log)
    try:
        query = crawl.append(crawl.read_stream(spark, source, 1), str(tmp_path / "out"), str(tmp_path / "check"), "parquet")
        query.awaitTermination()
        assert wait_for_end(spark, log, query.id)
        failed = spark.readStream.schema("id long").parquet(source).select(F.raise_error(F.lit("broken")).alias("x")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            failed.awaitTermination()
        assert wait_for_end(spark, log, failed.id)
    finally:
        spark.streams.removeListener(listener)
    assert [(r.query, r.batches, r.rows_in, r.ended) for r in totals(spark, log).collect()] == [(str(query.id), 3, 60, "done")]
    ends = {r.query: r.ended for r in progress(spark, log).where("ended is not null").collect()}
    assert ends[str(query.id)] == "done" and "broken" in ends[str(failed.id)]
