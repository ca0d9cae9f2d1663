"""Exact dedup, hard negatives and the Merkle manifest against plain versions, on the small tables and on odd ones."""

import hashlib
import math
import random
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F
from test_contracts import odd, table  # noqa: F401

from searchloom.llm import exact_dedup, hard_negatives, merkle


def copies(rows):
    """[(doc_id, keep_id, size, kept, digest)] of a list of (doc_id, text)."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), d is None, d or 0, i))
    out = []
    for body, own in groups.items():
        best = min(own)
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(rows[i][0], rows[best[3]][0], len(own), i == best[3], digest) for *_, i in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op11(spark, sf_dir, odd, where):  # noqa: F811
    folder = sf_dir if where == "sf" else odd
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    got = [tuple(r) for r in exact_dedup.op11_exact_dedup(spark, folder).collect()]
    assert sorted(got, key=str) == copies(rows)


def test_copies_of_one_length_or_prefix(spark):
    """What the first steps can't tell apart, the next ones do; white space alone makes no difference, other blanks do."""
    long = "a" * 300
    texts = ["ab c", "abc", " a\tb\nc\x0b\x0c\r", "abd", "ab c", long + "x", long + "y", long + " x", long, "", None, " ", "é", "é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, " a\tb\nc\x0b\x0c\r"), (None, "abc"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine")).withColumn("group_SIZE", F.lit(1))
    found = exact_dedup.mark_copies(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str) == sorted((x[:4] for x in copies(rows)), key=str)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {r.kept for r in left.collect()} == {"mine"}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((x[0] for x in copies(rows) if x[3]), key=str)


def test_full_hashes_of_survivors_alone(spark, monkeypatch):
    """Only rows whose length and prefix repeat are hashed whole, and a bitmap that is full changes nothing else."""
    docs = spark.createDataFrame([(i, f"{i:04}" + "x" * (i // 10)) for i in range(200)] + [(500, "0007"), (501, "0011x")], "doc_id long, text string")
    seen = {}
    keep = exact_dedup.save
    monkeypatch.setattr(exact_dedup, "save", lambda df, name: seen.setdefault(name, keep(df, name)))
    first = sorted(map(tuple, exact_dedup.mark_copies(docs).collect()))
    assert seen.pop("full-hashes").count() == 4
    seen.clear()
    monkeypatch.setattr(exact_dedup, "BITS", 32768)
    assert sorted(map(tuple, exact_dedup.mark_copies(docs).collect())) == first


def mined(rows, anchor=lambda i: i % 100 == 0, positives=5, negatives=5):
    """Rows of a list of (id, label, integer vector), by definition."""
    rows, out = sorted(set(rows)), []
    for a, la, va in rows:
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:positives]:
            fit = sorted(x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op12(spark, sf_dir, odd, where):  # noqa: F811
    folder = sf_dir if where == "sf" else odd
    rows = []
    for r in table(spark, folder, "embeddings").collect():
        if r.label is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, tuple(math.floor(256 * x) for x in r.embedding)))
    assert sorted(map(tuple, hard_negatives.op12_hard_negatives(spark, folder).collect())) == mined(rows) and (where == "odd" or len(mined(rows)) > 50)


def test_hard_negatives_of_ties_and_many_blocks(spark, monkeypatch):
    """Many equal vectors, equal scores, several lengths and files; small blocks, so that searches pass many."""
    for name, value in (("BLOCK", 8), ("FILE", 1500), ("PIVOTS", 5), ("ANCHORS", 3), ("SAMPLE", 40)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(3)
    rows = [(i, i % 3, tuple(rng.randrange(-3, 6) for _ in range(4))) for i in range(300)]
    rows += [(1000 + i, i % 2, (3, 3, 3, 3)) for i in range(150)] + [(i, 1, (2, -1)) for i in range(2000, 2030)] + [(2003, 0, (5, 1)), (2006, 0, (1, 1)), (10, 1, (9, 9, 9, 9)), (0, 2, rows[0][2])]
    rows += [rows[4], rows[301], (4000, 0, ()), (4010, 1, ()), (5000, 0, (1 << 20, 0, 0, 1)), (-20, 1, (1, 2, 3, 4))]
    extra = [(None, 1, (1, 1, 1, 1)), (7000, None, (1, 1, 1, 1)), (7001, 1, None)]
    df = spark.createDataFrame([(i, lab, None if v is None else list(v)) for i, lab, v in rows + extra], "id long, label int, v array<int>")
    got = sorted(map(tuple, hard_negatives.hard_negatives(df.repartition(3), F.col("id") % 10 == 0).collect()))
    assert got == mined(rows, lambda i: i % 10 == 0) and len(got) > 300


def test_quantised(spark):
    values = [[1.0, -0.001, 0.00391], [float("nan")], [float("inf")], [None], None, [1e300], [-2.5]]
    got = [r.q for r in spark.createDataFrame([(v,) for v in values], "v array<double>").select(hard_negatives.quantised(F.col("v")).alias("q")).collect()]
    assert got == [[256, -1, 1], None, None, None, None, None, [-640]]


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op13(spark, sf_dir, odd, where):  # noqa: F811
    folder = sf_dir if where == "sf" else odd
    rows = [tuple(r) for r in table(spark, folder, "documents").select(*merkle.COLUMNS).collect()]
    assert sorted(map(tuple, merkle.op13_merkle(spark, folder).collect()), key=str) == brute.merkle(rows)


def test_manifest_of_deep_prefixes(spark, tmp_path, monkeypatch):
    """Missing, repeated, sparse and negative ids, groups of one, many groups."""
    monkeypatch.setattr(merkle, "DEEP", 3)
    rows = [(None, None, "en", 3, "Abc")] * 3 + [(None, "a", "en", i, f"X{i}") for i in range(9)] + [(5, "a", None, 1, "T")] * 7
    rows += [(-3, "a", "e", 2, None), (7, "b", "x", 1, "y"), (5, "é", "x", 1, "Y y"), (-(2**63), "big", "q", 1, "Zz"), (2**63 - 1, "big", "q", 1, "Zz")]
    rows += [(i * 3**20, "big", "q", 1, "Zz") for i in range(-40, 40)] + [(i, f"s{i}", "q", 1, "Zz") for i in range(40)] + [(i, "hot", "q", 1, "Hot") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, merkle.op13_merkle(spark, str(tmp_path)).collect()), key=str) == brute.merkle(rows)


def test_a_change_is_found(spark):
    """The proofs of a manifest verify its rows, and fail for one that was changed."""
    docs = spark.createDataFrame([(i, f"s{i % 2}", f"t{i}") for i in range(50)], "doc_id long, source string, text string")
    proofs = merkle.manifest(docs, {"leaf": merkle.leaf(F.col("doc_id"), F.col("text"))})
    now = docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))
    rows = merkle.verified(proofs.join(now.select("doc_id", "text"), "doc_id"), merkle.leaf(F.col("doc_id"), F.col("text"))).collect()
    assert {r.doc_id for r in rows if not r.verified} == {7} and len(rows) == 50
