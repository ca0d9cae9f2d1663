"""Index, language model, feedback, TF-IDF and vectors on small corpora, against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from searchloom.functions.queries import process, weights
from searchloom.operators.index import Index, build_index, latest, merge_index
from searchloom.operators.language_model import LanguageModel
from searchloom.operators.tfidf import TextCollection, TfIdf
from searchloom.operators.vectors import VectorTable, scalar_columns
from searchloom.plans.search import search
from searchloom.schema import DOCUMENT

WORDS = "gato perro casa árbol libro coche playa monte río sol luna mar".split()


def documents(spark, texts, category="mobile", source="blog"):
    rows = [(str(i), f"u{i}", "", t, None, None, None, source, ["t"], category, "", None, None, None, None) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return {i: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12))) for i in range(25)} | {25: "de la", 26: ""}


@pytest.fixture(scope="module")
def model(spark, corpus):
    return LanguageModel.fit(build_index(documents(spark, corpus)), 50.0)


def dirichlet(corpus, query, mu):
    bags = {str(i): Counter(t.split()) for i, t in corpus.items() if i < 25}
    total = Counter()
    for b in bags.values():
        total.update(b)
    n = sum(total.values())
    out = {}
    for d, bag in bags.items():
        if any(t in bag for t in query):
            out[d] = sum(w * math.log((bag[t] + mu * (total[t] / n if t in total else 1e-9)) / (sum(bag.values()) + mu)) for t, w in query.items())
    return out


def as_table(spark, query):
    return spark.createDataFrame([(1, t, w) for t, w in query.items()], "query_id long, term string, weight double")


def test_index(spark, corpus, model):
    stats = model.stats().first()
    bags = [Counter(t.split()) for i, t in corpus.items() if i < 25]
    assert (stats.documents, stats.tokens) == (25, sum(sum(b.values()) for b in bags))
    assert stats.vocabulary == len(set().union(*bags))
    assert abs(model.collection.agg(F.sum("p")).first()[0] - 1) < 1e-9


def test_scores(spark, corpus, model):
    query = {"gato": 0.5, "playa": 0.25, "nunca": 0.25}
    expected = dirichlet(corpus, query, 50.0)
    short = {r.doc_id: r.score for r in model.scores(as_table(spark, query)).collect()}
    naive = {r.doc_id: r.score for r in model.naive_scores(as_table(spark, query)).collect()}
    assert short.keys() == naive.keys() == expected.keys()
    assert all(abs(short[d] - expected[d]) < 1e-9 and abs(naive[d] - expected[d]) < 1e-9 for d in expected)
    hits = model.retrieve(as_table(spark, query), 3).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == sorted(expected, key=lambda d: (-round(expected[d], 6), d))[:3]


def test_feedback(spark, corpus, model):
    query = {"gato": 0.6, "sol": 0.4}
    scores = dirichlet(corpus, query, 50.0)
    best = sorted(scores, key=lambda d: (-round(scores[d], 6), d))[:5]
    top = max(round(scores[d], 6) for d in best)
    odds = {d: math.exp(round(scores[d], 6) - top) for d in best}
    mass = Counter()
    for d in best:
        bag = Counter(corpus[int(d)].split())
        for t, tf in bag.items():
            mass[t] += tf / sum(bag.values()) * odds[d] / sum(odds.values())
    mixed = {t: 0.5 * query.get(t, 0) + 0.5 * mass[t] / sum(mass.values()) for t in mass | query}
    kept = dict(sorted(mixed.items(), key=lambda x: (-round(x[1], 12), x[0]))[:10])
    found = {r.term: r.weight for r in model.expand(as_table(spark, query)).collect()}
    assert found.keys() == kept.keys()
    assert all(abs(found[t] - w / sum(kept.values())) < 1e-9 for t, w in kept.items())
    only = {r.term: r.weight for r in model.expand(as_table(spark, query), alpha=1.0).collect() if r.weight}
    assert all(abs(only[t] - w) < 1e-9 for t, w in query.items())
    assert {r.term: r.weight for r in model.expand(as_table(spark, {"nunca": 1.0})).collect()} == {"nunca": 1.0}


def test_search(spark, model):
    asked = spark.createDataFrame([(1, "gato source:blog"), (2, ""), (3, "nunca"), (4, "gato source:otro")], "query_id long, query string")
    hits = search(model, asked, 4).collect()
    assert {h.query_id for h in hits} == {1, 4} and max(h["rank"] for h in hits) == 4 and hits[0].source == "blog"
    assert {h.query_id for h in search(model, asked, 4, apply_filters=True).collect()} == {1}
    assert search(model, asked, 4, category="pc").count() == 0


def test_save_and_load(spark, model, tmp_path):
    with pytest.raises(FileNotFoundError):
        LanguageModel.load(spark, str(tmp_path / "none"))
    model.save(str(tmp_path / "model"))
    back = LanguageModel.load(spark, str(tmp_path / "model"))
    query = as_table(spark, {"gato": 1.0})
    assert back.mu == 50.0 and sorted(back.retrieve(query).collect()) == sorted(model.retrieve(query).collect())


def test_merge_index(spark, corpus):
    old, new = {i: t for i, t in corpus.items() if i < 15}, {i: t for i, t in corpus.items() if i >= 10} | {3: "sol sol"}
    merged = merge_index(build_index(documents(spark, old)), documents(spark, new))
    whole = build_index(documents(spark, old | new))
    for name in ("postings", "doc_info"):
        assert sorted(map(str, getattr(merged, name).collect())) == sorted(map(str, getattr(whole, name).collect()))


def test_tfidf(spark, corpus):
    index = build_index(documents(spark, corpus))
    fitted = TfIdf.fit(index, len(corpus), max_features=8)
    bags = {i: Counter(t.split()) for i, t in corpus.items() if i < 25}
    cf, df = Counter(), Counter()
    for b in bags.values():
        cf.update(b)
        df.update(b.keys())
    kept = sorted(cf, key=lambda t: (-cf[t], t))[:8]
    idf = {t: math.log((1 + len(corpus)) / (1 + df[t])) + 1 for t in kept}
    assert {r.term: round(r.idf, 9) for r in fitted.vocabulary.collect()} == {t: round(x, 9) for t, x in idf.items()}

    def unit(bag):
        raw = {t: n * idf[t] for t, n in bag.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    query = unit(Counter(corpus[0].split()))
    cosines = {str(i): round(sum(x * query.get(t, 0) for t, x in unit(b).items()), 6) for i, b in bags.items()}
    best = sorted((d for d in cosines if cosines[d] > 0), key=lambda d: (-cosines[d], d))[:5]
    asked = spark.createDataFrame([(7, corpus[0].split())], "query_id long, tokens array<string>")
    hits = fitted.search(asked, 5).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == best and abs(hits[0].score - 1) < 1e-6


def test_vectors(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)], f"t{i}", None) for i in range(40)] + [(40, None, "n", None), (41, [0.0] * 6, "z", None)]
    table = VectorTable(spark.createDataFrame(data, "doc_id long, embedding array<float>, title string, url string"))
    hits = table.search(table.rows.where("doc_id = 3").select(F.col("doc_id").alias("query_id"), "embedding"), 5).orderBy("rank").collect()
    assert hits[0].doc_id == 3 and abs(hits[0].score - 1) < 1e-6 and len(hits) == 5
    new = spark.createDataFrame([(3, [1.0] * 6, "new", None), (99, [2.0] * 6, "more", "u")], table.rows.schema)
    after = table.upsert(new)
    assert after.stats().first().vectors == 43
    assert {r.doc_id: r.title for r in after.rows.where("doc_id in (3, 99)").collect()} == {3: "new", 99: "more"}
    shown = after.hits(new.select(F.lit(1).alias("query_id"), "embedding").limit(1), 2).collect()
    assert {h.title for h in shown} == {"new", "more"}
    with pytest.raises(ValueError, match="different"):
        VectorTable.setup(table.rows.select("doc_id", "embedding"), table.rows.where("doc_id > 1").select("doc_id", "title"))
    assert scalar_columns(spark.createDataFrame([], "id string, content string, a int, b boolean, c array<int>, d string")) == ["a", "b", "d"]


def test_latest_and_empty(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, n int")
    assert sorted(map(tuple, latest(rows, "k", [F.col("n")]).collect())) == [("a", 2), ("b", None)]
    empty = build_index(documents(spark, {1: ""}))
    assert isinstance(empty, Index) and empty.stats().first().documents == 0 and empty.collection().count() == 0


def test_plans_push_down(spark, sf_dir):
    from searchloom.plans import catalogue

    plan = catalogue.docs_in_category(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in plan and "text" not in plan.split("ReadSchema")[1]
    postings = catalogue.postings_tf(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in postings and postings.count("Exchange") == 1 and "INSET" in postings


def test_vectors_of_odd_kinds(spark):
    """Other lengths, nulls and non-finite components take no part; a zero vector's cosine is 0."""
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [1.0, 1.0]), (7, []), (8, [float("inf"), 0.0]), (9, [1.0, 2.0, 3.0])]
    table = VectorTable(spark.createDataFrame(rows, "doc_id long, embedding array<double>"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, None), (4, [None, 1.0])], "query_id long, embedding array<double>")
    found = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in table.search(asked).collect())
    assert found == [(1, 1, 1, 1.0), (1, 2, 6, 0.707107), (1, 3, 5, 0.0), (2, 1, 2, 1.0)]
    many = spark.range(5000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    assert table.search(many, 1).where("doc_id = 1").count() == 5000


def test_text_collection(spark, corpus, tmp_path):
    docs = documents(spark, corpus)
    model = TfIdf.fit(build_index(docs), docs)
    empty = TextCollection.open(spark, str(tmp_path / "none"))
    assert empty.stats().first().documents == 0
    asked = spark.createDataFrame([(7, corpus[0])], "query_id long, query string")
    for use in (lambda: empty.search(asked), lambda: empty.add(docs)):
        with pytest.raises(RuntimeError):
            use()
    store = TextCollection.setup(model, docs.select(F.col("id").alias("doc_id"), "title", "source"))
    hit = store.search(asked, 1).first()
    assert (hit.doc_id, round(hit.score, 6)) == ("0", 1.0)
    new = documents(spark, {0: corpus[1], 900: corpus[0]}, source="new")
    store.add(new).save(str(tmp_path / "some"))
    back = TextCollection.open(spark, str(tmp_path / "some"))
    hit = back.search(asked, 1).first()
    assert (hit.doc_id, hit.source, round(hit.score, 6)) == ("900", "new", 1.0) and back.stats().first().documents == len(corpus) + 1
    assert "content" not in back.metadata.columns and "tags" not in back.metadata.columns
    with pytest.raises(ValueError, match="no documents"):
        TfIdf.fit(build_index(docs.limit(0)), docs.limit(0))


def test_filters_before_the_best_are_chosen(spark, corpus):
    docs = documents(spark, corpus).unionByName(documents(spark, {i + 500: t for i, t in corpus.items()}, category="pc", source="other"))
    model = LanguageModel.fit(build_index(docs))
    asked = spark.createDataFrame([(1, corpus[0] + " source:other"), (2, corpus[0])], "query_id long, query string")
    found = search(model, asked, 3, feedback=False, apply_filters=True).collect()
    assert {r.source for r in found if r.query_id == 1} == {"other"} and sum(r.query_id == 1 for r in found) == 3 and sum(r.query_id == 2 for r in found) == 3
    plan = model.scores(weights(process(asked)), "pc")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


@pytest.fixture(scope="module")
def zipf(spark):
    """A corpus whose words are as frequent as in texts, with a few rare ones for each topic."""
    rng = random.Random(9)
    common = [f"palabra{i}" for i in range(200)]
    shares = [1 / (i + 1) for i in range(200)]
    texts = {i: " ".join(rng.choices(common, shares, k=rng.randrange(20, 60)) + [f"tema{i % 50}"] * (i % 3)) for i in range(1200)}
    return LanguageModel.fit(build_index(documents(spark, texts)))


def test_stored_model_prunes(spark, zipf, tmp_path, monkeypatch):
    """A saved model reads the folders of a query's terms and of its hits, and gives what the model in memory gives."""
    from searchloom.operators import stored

    monkeypatch.setattr(stored, "FOLDER_ROWS", 500)
    path = str(tmp_path / "model")
    zipf.save(path)
    model = LanguageModel.load(spark, path)
    assert model.index.term_folders >= 16 and model.index.doc_folders >= 2
    query = as_table(spark, {"tema7": 0.7, "palabra190": 0.3})
    hits = model.retrieve(query)
    assert sorted(hits.collect()) == sorted(zipf.retrieve(query).collect())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    blocks = next(line for line in plan.splitlines() if "FileScan" in line and "max_tf" not in line and "postings" in line)
    assert "dynamicpruning" in blocks and "PartitionFilters: [isnotnull(folder" in blocks
    found = model.relevance_model(query)
    whole = found._jdf.queryExecution().executedPlan().toString()
    read = [line for line in whole.splitlines() if "FileScan" in line and "struct<doc_id:string,term:string,tf:bigint>" in line]
    assert len(read) == 1 and "dynamicpruning" in read[0] and "postings" not in whole
    rounded = lambda m: {r.term: round(r.weight, 9) for r in m.collect()}
    assert rounded(found) == rounded(zipf.relevance_model(query))
    assert model.stats().first() == zipf.stats().first()


def test_block_bounds(spark, zipf, tmp_path):
    """The same rows from less than half of the postings; for any k, category, and queries without enough hits."""
    zipf.save(str(tmp_path / "model"))
    model = LanguageModel.load(spark, str(tmp_path / "model"))
    rows = [(q, t, 1 / 6) for q in range(8) for t in ("palabra0", "palabra1", "palabra2", "palabra3", f"tema{q}", f"tema{q + 8}")] + [(90, "nunca", 1.0), (91, "tema1", 1.0)]
    queries = spark.createDataFrame(rows, "query_id long, term string, weight double")
    for k in (1, 10, 200):
        assert sorted(model.pruned(queries, k)[0].collect()) == sorted(zipf.retrieve(queries, k).collect())
    assert sorted(model.pruned(queries, 5, "mobile")[0].collect()) == sorted(zipf.retrieve(queries, 5).collect()) and model.pruned(queries, 5, "pc")[0].count() == 0
    work = model.scored(queries.where("query_id < 8")).agg(F.sum("scored").alias("scored"), F.sum("matching").alias("matching")).first()
    assert 0 < work.scored < 0.5 * work.matching


def test_saved_in_place(spark, corpus, model, tmp_path):
    """A save to the path that was opened makes a generation; a reader keeps to its own."""
    path = str(tmp_path / "model")
    model.save(path)
    old = LanguageModel.load(spark, path)
    before = old.stats().first()
    LanguageModel.fit(merge_index(old.index, documents(spark, {100: "sol sol nuevo"})), 7.0).save(path)
    new = LanguageModel.load(spark, path)
    assert new.mu == 7.0 and new.stats().first().documents == before.documents + 1 and old.stats().first() == before
    with pytest.raises(FileNotFoundError):
        Index.load(spark, str(tmp_path / "none"))


def test_merge_index_takes_the_last_of_an_id(spark):
    docs = documents(spark, {1: "gato gato"}).unionByName(documents(spark, {1: "perro"}))
    merged = merge_index(build_index(documents(spark, {1: "luna", 2: "mar"})), docs)
    assert sorted(map(tuple, merged.postings.collect())) == [("mar", "2", 1), ("perro", "1", 1)]


def test_graph(spark, tmp_path):
    """Recall against the exact search over several shards; upserts replace and add; other lengths and odd vectors as there."""
    from searchloom.operators.graph import GraphIndex

    rng = random.Random(4)
    rows = [(f"d{i}", [rng.gauss(0, 1) for _ in range(12)]) for i in range(1500)] + [("two", [1.0, 2.0]), ("null", None), ("odd", [None] * 12), ("zero", [0.0] * 12)] + [(f"same{i}", [1.0] * 12) for i in range(40)]
    exact = VectorTable(spark.createDataFrame(rows, "doc_id string, embedding array<double>"))
    with pytest.raises(FileNotFoundError):
        GraphIndex.open(spark, str(tmp_path / "none"))
    graph = GraphIndex.build(exact.rows, str(tmp_path / "graph"), shard=400)
    assert graph.count == 4 and graph.stats().first().vectors == 1542

    def recall(table, graph, asked):
        best, found = ({(r.query_id, r.doc_id, r.score) for r in x.search(asked, 10).collect()} for x in (table, graph))
        return len(best & found) / len(best)

    asked = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(60)] + [(100, [2.0, 1.0]), (101, None)], "query_id long, embedding array<double>")
    assert recall(exact, graph, asked) >= 0.95
    new = spark.createDataFrame([(f"d{i}", [rng.gauss(0, 1) for _ in range(12)]) for i in range(1450, 1600)] + [("d1", [0.0, 1.0]), ("three", [1.0, 0.0, 0.0])], "doc_id string, embedding array<double>")
    after = graph.upsert(new)
    assert after.stats().first().vectors == 1542 + 102 and graph.stats().first().vectors == 1542
    more = asked.unionByName(spark.createDataFrame([(200, [3.0, 1.0, 0.0])], asked.schema))
    wide = exact.upsert(new.where("doc_id <> 'd1'"))
    assert recall(wide, after, more.where("query_id <> 100")) >= 0.95 and {r.doc_id for r in after.search(more).where("query_id = 200").collect()} == {"three"}
    assert GraphIndex.open(spark, str(tmp_path / "graph")).stats().first().vectors == 1644
    assert GraphIndex.build(exact.rows.limit(0), str(tmp_path / "empty")).search(asked).count() == 0


def test_named_normalizers(spark, tmp_path):
    """An index keeps its normaliser's name: merged documents, typed queries and collections use the same."""
    from searchloom.functions.text import register_normalizer

    register_normalizer("letters", lambda text: F.filter(F.split(F.upper(text), ""), lambda c: c.rlike("[A-Z]")))
    docs = documents(spark, {1: "de la", 2: "xyz"})
    path = str(tmp_path / "letters")
    LanguageModel.fit(build_index(docs, normalizer="letters")).save(path)
    model = LanguageModel.load(spark, path)
    assert model.index.normalizer == "letters" and {r.term for r in model.index.postings.collect()} == set("DELAXYZ")
    merged = merge_index(model.index, documents(spark, {3: "Q"}))
    assert merged.normalizer == "letters" and "Q" in {r.term for r in merged.postings.collect()}
    asked = spark.createDataFrame([(1, "yx")], "query_id long, query string")
    assert [r.doc_id for r in search(model, asked, normalize_query=True, feedback=False).collect()] == ["2"]
    store = TextCollection.setup(TfIdf.fit(model.index), docs.select(F.col("id").alias("doc_id"), "title"))
    store.save(str(tmp_path / "store"))
    opened = TextCollection.open(spark, str(tmp_path / "store"))
    opened.add(documents(spark, {9: "xxyyzz"})).save(str(tmp_path / "store"))  # in place
    again = TextCollection.open(spark, str(tmp_path / "store"))
    assert {r.doc_id for r in again.search(asked).collect()} == {"2", "9"} and opened.stats().first().documents == 2 and again.stats().first().documents == 3
    with pytest.raises(ValueError, match="no normaliser"):
        build_index(docs, normalizer="unknown")


def test_tfidf_stage(spark, corpus, tmp_path):
    """The stage's vectors are the collection's, in a pipeline that is saved and loaded."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.functions import vector_to_array

    from searchloom.operators.index import tokenized
    from searchloom.operators.ml import TextTfIdf

    docs = documents(spark, corpus)
    tokens = tokenized(docs).select("doc_id", "tokens")
    stage = TextTfIdf(maxFeatures=8)
    stage.save(str(tmp_path / "stage"))
    Pipeline(stages=[TextTfIdf.load(str(tmp_path / "stage"))]).fit(tokens).save(str(tmp_path / "model"))
    model = PipelineModel.load(str(tmp_path / "model"))
    terms, out = model.stages[0].stages[0].vocabulary, model.transform(tokens)
    assert out.columns == ["doc_id", "tokens", "vector"]
    found = {(r.doc_id, terms[i], round(w, 9)) for r in out.select("doc_id", vector_to_array("vector").alias("v")).collect() for i, w in enumerate(r.v) if w}
    assert found == {(r.doc_id, r.term, round(r.w, 9)) for r in TfIdf.fit(build_index(docs), docs, max_features=8).vectors.collect()}
    with pytest.raises(ValueError, match="no tokens"):
        stage.fit(tokens.limit(0))


def test_no_model(spark):
    with pytest.raises(RuntimeError, match="no model"):
        LanguageModel().retrieve(as_table(spark, {"gato": 1.0}))
