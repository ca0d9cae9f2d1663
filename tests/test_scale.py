"""What keeps work in proportion to the input: where rows are moved, how many there are of a kind, and what is never made."""

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from searchloom import session
from searchloom.operators import language_model, stored
from searchloom.operators.index import build_index
from searchloom.operators.language_model import LanguageModel
from searchloom.operators.ml import entries
from searchloom.plans import catalogue
from searchloom.sources import paced
from searchloom.streaming import crawl


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def documents(spark, texts):
    return catalogue.as_documents(spark.createDataFrame([(i, t, "xx", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string"))


def test_scores_are_summed_where_postings_are_read(spark, sf_dir):
    """Neither postings nor what they add to scores is shuffled, in queries by language model and by vectors."""
    for query in (catalogue.ql_batch_topk, catalogue.flagship_ql_rm3, catalogue.ql_dirichlet_category, catalogue.tfidf_cosine_topk):
        plan = plan_of(query(spark, sf_dir))
        assert "Bucketed: true" in plan and "hashpartitioning(doc_id" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(query_id#" in plan
        assert not any("doc_id#" in line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line)


def test_a_terms_counts_are_summed_where_its_document_is(spark, sf_dir):
    plan = plan_of(catalogue.postings_tf(spark, sf_dir))
    assert "hashpartitioning(id" in plan and "hashpartitioning(term" not in plan


def test_ranges_grow_with_the_collection(spark, tmp_path, monkeypatch):
    """A term has no more blocks in a large collection than ranges are aimed at; scores are the same, frequent terms being several tasks' work."""
    monkeypatch.setattr(stored, "RANGES", 4, raising=False)
    monkeypatch.setattr(stored, "FOLDER_ROWS", 100)
    model = LanguageModel.fit(build_index(documents(spark, {i: f"gato {'perro ' * (i % 3)} palabra{i % 7} solo{i}" for i in range(600)})))
    model.save(str(tmp_path / "m"))
    saved = LanguageModel.load(spark, str(tmp_path / "m"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert saved.index.blocks.where("term = 'gato'").count() <= 4 + parts and saved.index.blocks.agg(F.sum("n")).first()[0] == model.index.postings.count()
    asked = spark.createDataFrame([(1, "gato", 0.5), (1, "solo7", 0.5), (2, "perro", 1.0)], "query_id long, term string, weight double")
    expected = sorted(model.retrieve(asked).collect())
    found = saved.retrieve(asked)
    assert sorted(found.collect()) == expected == sorted(saved.pruned(asked)[0].collect())
    plan = plan_of(found)
    assert "hashpartitioning(range" in plan and "hashpartitioning(query_id#" in plan and not any("doc_id#" in x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])


def test_a_quick_crawl_has_few_batches(monkeypatch):
    """Turns of a batch double while batches are quick; not where the delay or the pages take their time."""
    monkeypatch.setattr(paced.PagesReader, "_ends", lambda self: {"0": 200_000, "1": 10})

    def batches(delay, seconds):
        now = [0.0]
        monkeypatch.setattr(paced.time, "time", lambda: now[0])
        reader, n = paced.PagesReader({"path": "p", "fetcher": "f", "delay": str(delay), "batch": "64", "stop": "1e9"}), 0
        while n < 5000 and (reader.last or {"lanes": {}})["lanes"].get("0", 0) < 200_000:
            reader.latestOffset()
            n, now[0] = n + 1, now[0] + seconds
        return n

    assert batches(0, 1) < 30 and batches(5.5, 400) == batches(0, 60) == 3125


def test_entries_of_vectors(spark):
    rows = spark.createDataFrame([(1, Vectors.sparse(9, [2, 7], [0.5, 0.0])), (2, Vectors.dense([0.0, 3.0])), (3, Vectors.sparse(4, [], [])), (4, Vectors.dense([]))], ["id", "v"])
    found = entries(rows, "v")
    assert sorted((r.id, r.i, r.w) for r in found.collect()) == [(1, 2, 0.5), (2, 1, 3.0)]


def test_generations_move_what_was_replaced(spark, tmp_path):
    """Postings of all generations stay where they are; only documents that came again leave theirs."""
    for number, texts in enumerate(({1: "gato perro", 2: "luna"}, {2: "sol sol"})):
        documents(spark, texts).coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
        stream = crawl.read_stream(spark, str(tmp_path / f"in/{number}"))
        crawl.index_each_batch(stream, str(tmp_path / f"out{number}"), str(tmp_path / f"c{number}")).awaitTermination()
    for name in ("postings", "doc_info", "ids"):
        spark.read.parquet(str(tmp_path / f"out1/{name}/generation=0")).write.parquet(str(tmp_path / f"out0/{name}/generation=1"))
    index = crawl.load_generations(spark, str(tmp_path / "out0"))
    assert sorted(map(tuple, index.postings.collect())) == [("gato", "1", 1), ("perro", "1", 1), ("sol", "2", 2)]
    assert "hashpartitioning" not in plan_of(index.postings)


def test_a_saved_model_leaves_its_own_tables_alone(spark, sf_dir):
    """The index that a model is saved from is gone when it is loaded, and a generation holds what queries read."""
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "searchloom"
    before = set(folder.glob("*"))
    model = catalogue.saved_model(spark, sf_dir)
    (saved,) = set(folder.glob("*")) - before
    assert {p.name for p in saved.glob("generations/*/index/generations/*/*")} == {"blocks", "documents", "terms"} and model.stats().first().documents > 0


def test_shuffles_of_a_save_go_with_its_writes(spark):
    """Settings hold during a write alone."""
    names = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.requireAllClusterKeysForCoPartition"
    before = [spark.conf.get(n) for n in names]
    with session.brief_shuffles(spark), session.joins_in_place(spark):
        assert [spark.conf.get(n) for n in names] == ["true", "false"]
    assert [spark.conf.get(n) for n in names] == before


def test_parts_of_a_query_follow_its_matches(spark, tmp_path, monkeypatch):
    """However few partitions the session sets, a task adds up so many matches; bounds are joined to their blocks where these lie."""
    model = LanguageModel.fit(build_index(documents(spark, {i: f"gato {'perro ' * (i % 3)} palabra{i % 7} solo{i}" for i in range(600)})))
    model.save(str(tmp_path / "m"))
    saved = LanguageModel.load(spark, str(tmp_path / "m"))
    asked = spark.createDataFrame([(1, "gato", 0.5), (1, "perro", 0.5), (2, "perro", 1.0)], "query_id long, term string, weight double")
    monkeypatch.setattr(language_model, "TASK_MATCHES", 100)
    found = saved.retrieve(asked)
    assert "hashpartitioning(range#" in plan_of(found) and ", 14)" in plan_of(found)  # 600 and twice 400 matches
    pruned, work = saved.pruned(asked)
    assert sorted(found.collect()) == sorted(pruned.collect()) == sorted(model.retrieve(asked).collect())
    with session.joins_in_place(spark):
        late = plan_of(work["late"].select("range"))
    assert "Bucketed: true" in late and "hashpartitioning" not in late


def test_blocks_are_summed_in_the_order_of_their_rows(spark, tmp_path):
    """Sorted rows are neither hashed nor sorted again; a block's postings are in order, whatever their number."""
    rows = spark.range(100).selectExpr("id % 7 AS k", "id").repartition(3, "k").sortWithinPartitions("k", "id")
    with session.sums_in_order(spark):
        plan = plan_of(rows.groupBy("k").agg(F.collect_list("id")))
    assert "ObjectHashAggregate" not in plan and plan.count("Sort [") == 1
    model = LanguageModel.fit(build_index(documents(spark, {i: f"gato palabra{i % 3} solo{i}" for i in range(300)})))
    model.save(str(tmp_path / "m"))
    blocks = LanguageModel.load(spark, str(tmp_path / "m")).index.blocks.selectExpr("n", "postings.doc_id AS ids").collect()
    assert sum(b.n for b in blocks) == 900 and all(b.ids == sorted(b.ids) and len(b.ids) == b.n for b in blocks)
