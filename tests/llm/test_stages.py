"""Every stage of the pipeline on the odd tables, against plain versions: which rows stay, with which texts."""

import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from test_contracts import odd, table  # noqa: F401
from tokenizers import Tokenizer

from searchloom.llm import ann, ngram_join, quality

STAGE = dict(corpus_pipeline.STAGES)


def content(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def least_of_classes(rows):
    """The rows that stay: of each class the least doc_id, one without an id last, then the first."""
    classes = {}
    for i, (c, _) in brute.near_duplicates([(i, t) for i, (_, t) in enumerate(rows)]).items():
        classes.setdefault(c, []).append((rows[i][0] is None, rows[i][0] or 0, i))
    return Counter(rows[min(own)[2]] for own in classes.values())


def test_near_duplicates_go_by_row(spark, odd):  # noqa: F811
    say = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, say("a")), (5, say("a")), (5, say("b")), (7, say("c")), (7, say("c")), (None, say("a")), (None, say("a")), (None, say("d")), (None, say("d")), (8, None), (8, None), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = content(ngram_join.near_duplicate_stage(spark, docs, ""))
    assert found == Counter([(1, say("a")), (5, say("b")), (7, say("c")), (None, say("d")), (8, None), (8, None), (9, ""), (None, None)])
    whole = [(r.doc_id, r.text) for r in table(spark, odd, "documents").collect()]
    assert content(STAGE["n-gram Jaccard join"](spark, table(spark, odd, "documents"), odd)) == least_of_classes(whole)


def test_lines_and_contamination(spark, odd):  # noqa: F811
    docs = table(spark, odd, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ordered = [rows[i] for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))]
    assert content(STAGE["line dedup"](spark, docs, odd)) == Counter((d, t) for d, t, _ in brute.line_dedup(ordered))
    items = [(-i - 1 if r.item_id is None else r.item_id, r.text) for i, r in enumerate(table(spark, odd, "benchmark").collect())]
    clean = Counter(rows[i] for i, x in brute.contamination(rows, items).items() if not x[4])
    assert content(STAGE["benchmark decontamination"](spark, docs, odd)) == clean and 0 < sum(clean.values()) < len(rows)


def test_quality_keeps_what_op4_accepts(spark, odd):  # noqa: F811
    docs = table(spark, odd, "documents")
    accepted = Counter(r.doc_id for r in quality.op4_quality(spark, odd).collect() if r.predicted == 1)
    found = STAGE["quality classifier"](spark, docs, odd)
    assert Counter(r.doc_id for r in found.collect()) == accepted and set(content(found)) <= set(content(docs))


def test_quality_of_one_class(spark, odd, tmp_path):  # noqa: F811
    """Without a label of one class the other is all there is to learn; nothing fails."""
    for name in ("documents", "labels"):
        rows = table(spark, odd, name)
        (rows if name == "documents" else rows.where("quality = 1")).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = table(spark, str(tmp_path), "documents")
    assert STAGE["quality classifier"](spark, docs, str(tmp_path)).count() == docs.count()


def test_packing_has_every_id_once(spark, odd):  # noqa: F811
    docs = table(spark, odd, "documents")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in docs.collect():
        ids.setdefault((r.doc_id, len(own := [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])), []).append(own)
    pieces = STAGE["packing"](spark, docs, odd).collect()
    assert sum(p.length for p in pieces) == sum(len(own) for rows in ids.values() for own in rows)
    for p in pieces:
        assert any(zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for own in ids[p.doc_id, p.doc_tokens])


def test_nearest_over_many_shards(spark, sf_dir, monkeypatch):
    """With shards of 64 vectors the cells, the routing and the stopping test between shards all run; the recall holds."""
    monkeypatch.setattr(ann, "SHARD", 64)
    rows = {r.vec_id: np.array(r.embedding, float) for r in table(spark, sf_dir, "embeddings").collect()}
    got = {}
    for r in ann.op5_nearest(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q, own in got.items():
        best = sorted((-float(v @ rows[q]), i) for i, v in rows.items() if i != q)[:20]
        assert [r for r, *_ in sorted(own)] == list(range(1, 21)) and all(abs(s - rows[d] @ rows[q]) < 1e-9 for _, d, s in own)
        hit += len({i for _, i in best} & {d for _, d, _ in own})
        total += 20
    assert hit >= 0.9 * total and set(got) == {i for i in rows if i % 20 == 0}


def test_many_benchmark_blocks(spark, odd, monkeypatch):  # noqa: F811
    """A benchmark of more blocks than a task keeps meets all shards of a batch, with the same verdicts and matches."""
    from searchloom.llm import decontaminate

    docs, bench = table(spark, odd, "documents"), table(spark, odd, "benchmark")
    plain = sorted(map(str, decontaminate.judge(docs, bench, columns=["doc_id"], matches="m").collect()))
    reads = []
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    monkeypatch.setattr(decontaminate, "SHARD", 300)
    monkeypatch.setattr(decontaminate, "write_benchmark", lambda *a, f=decontaminate.write_benchmark: reads.append(f(*a)) or reads[-1])
    found = sorted(map(str, decontaminate.judge(docs, bench, columns=["doc_id"], matches="m").collect()))
    assert len(reads[0]) > decontaminate.CACHED and found == plain
