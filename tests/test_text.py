import re
import uuid

import pytest
from pyspark.sql import functions as F

from searchloom.functions import detect, queries, text
from searchloom.plans import oracle


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_stop_words():
    words = text.stop_words()
    assert len(words) == 313 and "de" in words and "la" in words


def test_stop_words_equal_the_library(spark):
    """Spark ML ships the same list; nothing but this test reads it."""
    feature = pytest.importorskip("pyspark.ml.feature")
    assert set(text.stop_words()) == set(feature.StopWordsRemover.loadDefaultStopWords("spanish"))


def test_sql_needs_no_file_of_spark(monkeypatch, tmp_path):
    """The SQL is made of the package alone, wherever Spark's own files lie."""
    monkeypatch.setattr("pyspark.__file__", str(tmp_path / "pyspark" / "__init__.py"))
    text.stop_words.cache_clear()
    assert "'vosostros'" in oracle.sql_map()["collection_model"]


def test_normalize(spark):
    assert one(spark, text.normalize, None) == []
    assert one(spark, text.normalize, "") == []
    sample = "¡Hola! Visita https://example.org/a?b y www.x.com — el móvil_1 de María, 5G x €uro"
    expected = [t for t in re.sub(r"[^\w\s]", " ", re.sub(r"https?://\S+|www\.\S+", " ", sample.lower())).split() if len(t) > 1 and t not in text.stop_words()]
    assert one(spark, text.normalize, sample) == expected
    assert one(spark, lambda c: text.normalize(c, contractions=True), "cannot gonna") == ["can", "not", "gon", "na"]


def test_clean(spark):
    assert one(spark, text.clean, "  A \t\nB c ") == "a b c"


def test_first_filled(spark):
    row = spark.createDataFrame([("", None, "c"), ("a", "b", "c"), (None, "", "")], "a string, b string, c string")
    assert [r[0] for r in row.select(text.first_filled(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["c", "a", ""]


def test_parse_and_weigh(spark):
    asked = spark.createDataFrame([(1, "iPhone 16 source:blog  source:news"), (2, None), (3, "https://x.org b b c")], "query_id long, query string")
    found = {r.query_id: r for r in queries.process(asked).collect()}
    assert found[1].text == "iphone 16" and found[1].filters == {"source": "news"} and not found[1].expanded and found[1].original == "iPhone 16 source:blog  source:news"
    assert found[2].tokens == [] and found[2].filters == {}
    assert found[3].filters == {"https": "//x.org"}
    weights = {(r.query_id, r.term): r.weight for r in queries.weights(queries.process(asked)).collect()}
    assert weights == {(1, "iphone"): 0.5, (1, "16"): 0.5, (3, "b"): 2 / 3, (3, "c"): 1 / 3}


def test_detectors(spark):
    for said, name, system in (("Google Pixel y Samsung", "Samsung", None), ("los usuarios", None, "iOS"), ("moto g", "Motorola", None), ("motor", None, None), ("iPad", "Apple", "iPadOS")):
        assert one(spark, detect.brand, said) == name
        assert one(spark, detect.operating_system, said) == system
    assert one(spark, detect.pc_subcategory, "Laptops") == "pc"
    assert one(spark, detect.pc_subcategory, "portátiles y hardware") == "laptop"
    assert one(spark, detect.sink_category, "pc_mobile") == "mobile"


def test_uuid5(spark):
    for name in ("", "x", "añ €"):
        assert one(spark, detect.uuid5, name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_sql_functions(spark):
    """The SQL functions give what the column functions give; extract passes the table's columns on."""
    from searchloom.functions import sql
    from searchloom.functions.detect import brand, operating_system
    from searchloom.functions.text import clean, normalize
    from searchloom.sources.html import PLAIN, Profile

    sql.register(spark, {"own": Profile(content="main", links="nav a")})
    texts = ["La casa de los GATOS-negros it's https://x.y/z?q", "  iPhone   16 con One UI ", "", None, "un\\dos 'tres' ñandú_9 \n\t x"]
    spark.createDataFrame([(t,) for t in texts], "t string").createOrReplaceTempView("sql_texts")
    t = F.col("t")
    expected = spark.table("sql_texts").select(normalize(t), clean(t), brand(t), operating_system(t)).collect()
    assert [tuple(r) for r in spark.sql("SELECT normalize_text(t), clean_query(t), brand_of(t), os_of(t) FROM sql_texts").collect()] == [tuple(r) for r in expected]
    page = "<h1>T</h1><main><p>a</p></main><nav><a href='/x'>x</a></nav><a href='/y'>y</a>"
    spark.createDataFrame([(1, page, [2]), (2, None, None)], "id int, page string, more array<int>").createOrReplaceTempView("sql_pages")
    rows = spark.sql("SELECT id, more, title, content, links FROM extract(TABLE(sql_pages), 'page', 'own') ORDER BY id").collect()
    assert [tuple(r) for r in rows] == [(1, [2], "T", "a", ["/x"]), (2, None, None, "", [])]
    assert spark.sql("SELECT links FROM extract(TABLE(SELECT page FROM sql_pages WHERE id = 1), 'page', 'plain')").first().links == ["/x", "/y"] and PLAIN.links == "a"
    with pytest.raises(Exception, match="no profile"):
        spark.sql("SELECT * FROM extract(TABLE(sql_pages), 'page', 'none')")
