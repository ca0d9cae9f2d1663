"""Quality, line dedup, n-gram join, decontamination and suffix dedup against plain versions."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from searchloom.llm import components, decontaminate, line_dedup, merge, ngram_join, quality, suffix_dedup, textbytes

VOCABULARY = ["gato", "perro", "the", "of", "É", "naïve", "x1", "Zu", "日本", "a", "rain", "sun", "tree", "house", "sea", "moon"]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): nulls, empties, ties, repeats, near copies, shared passages, a very long text."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(12)]
    shared = prose(rng, 70)
    lines = [prose(rng, 6) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(20, None), (21, ""), (22, "one"), (23, "a b c"), (24, "A b C!"), (25, "!!! ..."), (26, "\n\n")]
    docs += [(30 + i, base[0]) for i in range(4)] + [(3, base[3]), (3, base[3])]
    near = base[1].split()
    for i in range(6):
        other = list(near)
        other[(i * 7) % len(other)] = "changed"
        docs.append((40 + i, " ".join(other)))
    docs += [(50, prose(rng, 10) + " " + shared + " " + prose(rng, 9)), (51, shared), (52, prose(rng, 30) + shared[5:260])]
    docs += [(60 + i, "\n".join(rng.sample(lines, 3) + lines[2:9] + rng.sample(lines, 4))) for i in range(8)]
    docs.append((70, prose(rng, 30_000)))
    return docs


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With further columns whose names the operators use themselves."""
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    more = "lang source n_chars row score statistics n_words matches class_id sequence_id _row known h".split()
    return df.select("*", *(F.lit("x").alias(c) for c in more))


def test_hashes_are_position_free():
    w = textbytes.Words([b"ab cd ab", b"CD", b""])
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.count.tolist() == [3, 1, 0]


def test_shingles_of_short_texts():
    doc, _ = textbytes.shingles(textbytes.Words([b"a b c", b"", b"a b c d e f"]), 5)
    assert doc.tolist() == [0, 2, 2]


def test_line_dedup(spark, docs, texts):
    found = line_dedup.remove_repeated_chunks(docs, removed="gone")
    assert found.columns == [*docs.columns, "gone"]
    distinct = [x for i, x in enumerate(texts) if x not in texts[:i]]
    ordered = sorted(texts, key=lambda x: x[0])
    expected = brute.line_dedup(ordered)
    got = sorted((r.doc_id, r.text or "", r.gone) for r in found.collect())
    assert [(d, t) for d, t, _ in got if d in (20, 21)] == [(20, ""), (21, "")]
    assert got == sorted((d, t or "", n) for d, t, n in expected) and sum(n for _, _, n in got) > 0 and len(distinct) < len(texts)
    assert [r.text for r in found.where("doc_id = 20").collect()] == [None]


def test_line_dedup_is_native(docs):
    assert "Python" not in line_dedup.remove_repeated_chunks(docs)._jdf.queryExecution().executedPlan().toString()


def passages(docs):
    """[(doc_id, text, lines removed)] without the lines of pairs that come before."""
    seen, out = set(), []
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        gone = set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if pair in seen:
                gone |= {i, i + 1}
            seen.add(pair)
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_repeated_passages(spark, docs, texts):
    """Shared passages of 2 to 8 lines go whole, whatever lines are before and after them."""
    rng = random.Random(9)
    fresh = lambda n: [prose(rng, 9) for _ in range(n)]
    rows, own = [], {}
    for size in range(2, 9):
        for k in range(6):
            shared = fresh(size)
            for copy in range(3):
                d = 1000 * copy + 10 * size + k
                before, after = fresh(rng.randrange(4)), fresh(rng.randrange(4))
                rows.append((d, "\n".join(before + shared + after)))
                own[d] = "\n".join(before + (shared if not copy else []) + after)
    found = line_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), removed="gone")
    assert {r.doc_id: r.text for r in found.collect()} == own and "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert dict(x[:2] for x in brute.line_dedup(sorted(rows))) != own
    found = line_dedup.remove_repeated_passages(docs, removed="gone")
    assert found.columns == [*docs.columns, "gone"]
    expected = passages(sorted(texts, key=lambda x: x[0]))
    assert sorted(((r.doc_id, r.text, r.gone) for r in found.collect()), key=repr) == sorted(expected, key=repr) and sum(n for _, _, n in expected) > 0
    assert line_dedup.remove_repeated_passages(docs.limit(0)).count() == 0


def test_near_duplicates(spark, docs, texts):
    found = ngram_join.near_duplicates(docs)
    expected = brute.near_duplicates(texts)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == sorted((texts[i][0], *x) for i, x in expected.items())


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """More near copies than a block holds: all pairs are verified, block against block."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(1000)}" for _ in range(80)]
    rows = []
    for i in range(600):
        own = list(base)
        own[rng.randrange(80)] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(1000)}" for _ in range(50))) for i in range(20)]
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute.near_duplicates(rows)
    assert found == {rows[i][0]: x for i, x in expected.items()}


def test_forest_depth():
    d = ngram_join.depth_for(0.8)
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.RECALL
    assert ngram_join.depth_for(0.99) >= d >= ngram_join.depth_for(0.5)


def test_near_duplicate_stage_keeps_one(spark, docs, texts, sf_dir):
    kept = ngram_join.near_duplicate_stage(spark, docs, sf_dir)
    near = brute.near_duplicates(texts)
    expected = {d for i, (d, _) in enumerate(texts) if near[i][0] == d}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == expected


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    touched = {x for a, b in edges if a != b for x in (a, b)}
    found = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in found.collect()} == {x: root(x) for x in touched}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block_bytes", [16_000_000, 300])
def test_decontamination(spark, docs, texts, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items = [(1, texts[2][1][:120]), (2, "one"), (3, None), (4, " ... "), (10, texts[-1][1][5000:5400]), (11, texts[0][1][:200]), (12, texts[0][1][:200])]
    found = decontaminate.judge(docs.select("doc_id", "text", "lang"), spark.createDataFrame(items, "item_id long, text string"), matches="places")
    expected = brute.contamination(texts, items)
    got = sorted((r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in found.collect())
    assert got == sorted((texts[i][0], x) for i, x in expected.items())
    long = next(r for r in found.collect() if r.doc_id == 70)
    w, item = brute.words(texts[-1][1]), brute.words(items[4][1])
    for m in long.places:
        assert m.item_id == 10 and w[m.doc_word : m.doc_word + m.n_words] == item[m.item_word : m.item_word + m.n_words]
    assert max(m.n_words for m in long.places) >= len(item) - 2


@pytest.mark.parametrize("block_bytes", [16_000_000, 300])
def test_decontamination_by_items_without_id(spark, docs, texts, monkeypatch, block_bytes):
    """They hit and contaminate as any other; only ids that aren't null are counted and digested."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items = [(None, texts[2][1][:200]), (None, texts[0][1][:200]), (11, texts[0][1][:120]), (12, texts[5][1][:120]), (None, texts[-1][1][5000:5400])]
    found = decontaminate.judge(docs.select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string"), matches="places").collect()
    named = [(-i - 1 if d is None else d, t) for i, (d, t) in enumerate(items)]
    hit = sorted((texts[i][0], (x[0], x[1], x[4])) for i, x in brute.contamination(texts, named).items())
    ids = sorted((texts[i][0], x[2:4]) for i, x in brute.contamination(texts, [x for x in items if x[0] is not None]).items())
    assert sorted((r.doc_id, (r.n_words, r.n_hit, r.contaminated)) for r in found) == hit
    assert sorted((r.doc_id, (r.n_items, r.items_sha256)) for r in found) == ids
    alone = next(r for r in found if r.doc_id == 2)
    assert alone.contaminated and alone.n_items == 0 and {m.item_id for m in alone.places} == {None}


def test_decontamination_without_items(spark, docs):
    found = decontaminate.judge(docs.select("doc_id", "text"), spark.createDataFrame([], "item_id long, text string"))
    assert found.where("contaminated").count() == 0 and found.count() == docs.count()


def test_suffix_array():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 4, 200).astype(np.uint64)
    words[[50, 120, 199]] = 0
    order, rank = decontaminate.suffix_array(words, 200)
    assert order.tolist() == sorted(range(200), key=lambda i: words[i:].tolist())


def test_merge_never_differs_from_sort():
    rng = random.Random(4)
    for _ in range(50):
        width = rng.choice((3, 9, 40))
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(width)) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))]
        coded = [merge.front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, width)) for r in runs]
        at, out = [0] * len(runs), []
        for k, common in merge.merge([merge.decode(*c, width) for c in coded]):
            s = runs[k][at[k]]
            at[k] += 1
            if out:
                assert common == next((i for i in range(width) if s[i] != out[-1][i]), width)
            out.append(s)
        assert out == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("length", [200, 40])
def test_suffix_dedup(spark, docs, texts, length):
    some = docs.where("doc_id <> 70")
    found = suffix_dedup.remove_repeats(some, length=length)
    assert found.columns == [*(c for c in docs.columns if c != "text"), "n_bytes", "n_removed", "n_spans", "kept"]
    expected = brute.repeats([x for x in texts if x[0] != 70], length)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())
    assert got == sorted(expected) and sum(x[2] for x in got) > 0


def test_suffix_dedup_of_periodic_texts(spark):
    rows = [(1, "ab" * 150), (2, "a" * 199), (3, "a" * 200), (4, "a" * 201), (5, "é" * 100 + "x" + "é" * 100), (6, "\x00" * 250)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()) == sorted(brute.repeats(rows, 200))


def test_quality_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    found = quality.op4_quality(spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    judged = found.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in judged) >= 0.95 * len(judged)
    assert all(r.held_out == (quality.crc_mod_3(r.doc_id) == 1) for r in found.collect())
    assert all(0 <= r.score <= 1 for r in found.collect()) and found.count() == 1000


def test_quality_of_odd_texts(spark, docs):
    measured = quality.measure(docs, out="m")
    labelled = measured.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    model = quality.fit(labelled, "m")
    found = quality.score(docs, model, "text", out="s")
    assert found.columns == [*docs.columns, "s"] and found.where("s is null or s < 0 or s > 1").count() == 0
    alone = quality.fit(labelled.where("quality = 1"), "m")
    assert {r.s for r in quality.score(docs, alone, "text", out="s").collect()} == {0.5}
    assert quality.fit(labelled.limit(0), "m").good is None


def test_empty_tables(spark, docs, sf_dir):
    none = docs.limit(0)
    assert line_dedup.remove_repeated_chunks(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert decontaminate.judge(none.select("doc_id", "text"), none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
