"""Every opN query and every stage, called as the driver calls them: columns, types, whole results, and odd tables."""

import hashlib
import random
import zlib

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from searchloom.llm import ann, chat, decontaminate, line_dedup, ngram_join, packing, quality, registry, suffix_dedup, tokenfile, warc

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMAS = {
    "op1_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2_token_file": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_ngram_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op6_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op7_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_line_dedup": "doc_id bigint, text string, lines_removed int",
    "op9_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op12_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


def kinds(df):
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, ties, repeated rows and further columns."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    shared = say(60)
    docs = [(i, say(rng.randrange(5, 150)), "en", f"s{i % 3}") for i in range(30)]
    docs += [(40, None, None, None), (41, "", "en", None), (42, " \n\n ", "fr", "s0"), (None, "no id " + shared, "en", "s1"), (None, None, "en", "s1")]
    docs += [(43, docs[3][1], "en", "s1"), (43, docs[3][1], "en", "s1"), (44, docs[3][1] + " tail", "en", "s1"), (45, say(10) + " " + shared, "en", "s2"), (46, shared, "en", "s2")]
    docs += [(47, "\n".join([say(8)] * 3 + [shared, say(9)]), "en", "s1"), (48, say(40_000), "en", "s1")]
    folder = str(tmp_path_factory.mktemp("odd"))
    write = lambda df, name: df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    extra = "score n_words contaminated class_id n_bytes kept_sha256 row shard part c0 Text_ statistics label sequence_id".split()
    table = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], DOCUMENTS)
    write(table.select("*", *(F.lit("x").alias(c) for c in extra)), "documents")
    write(spark.createDataFrame([(1, shared), (2, None), (3, ""), (4, "w1"), (None, docs[5][1]), (5, shared)], "item_id long, text string"), "benchmark")
    write(spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, 1, None), (None, 1, 0), (5, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int"), "labels")
    write(spark.createDataFrame([(1, None, None), (2, "http://a.b/", "x" * 2000), (3, "http://a.b/", "x" * 2000), (None, "u", "x" * 2000), (4, "", ""), (5, "http://long/", "é" * 3_000_000)], "page_id long, url string, html string"), "pages")
    vectors = [(i, [float(rng.gauss(0, 1)) for _ in range(8)]) for i in range(60)] + [(61, None), (62, [0.0] * 8), (63, [float("nan")] * 8), (64, [1.0, None] + [0.0] * 6), (80, [1.0, 2.0]), (81, [2.0, 1.0])]
    write(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("label", (F.col("vec_id") % 3).cast("int")), "embeddings")
    write(spark.createDataFrame([(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 1, None, "tie"), (1, None, "assistant", "when?"), (None, 0, "assistant", "x")], "conv_id long, turn long, role string, text string"), "conversations")
    return folder


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("name", list(SCHEMAS))
def test_columns(spark, sf_dir, odd, name):
    assert kinds(registry.queries()[name](spark, sf_dir)) == SCHEMAS[name]
    assert kinds(registry.queries()[name](spark, odd)) == SCHEMAS[name]


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op2(spark, sf_dir, odd, tokenizer, where):
    folder = sf_dir if where == "sf" else odd
    rows = sorted(((r.doc_id, r.text or "") for r in table(spark, folder, "documents").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, at = [], 0
    for d, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, map(tuple, tokenfile.op2_token_file(spark, folder).collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op3(spark, sf_dir, odd, where):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir if where == "sf" else odd, "documents").collect()]
    named = [r for r in rows if r[0] is not None]
    expected = [(named[i][0], *x) for i, x in brute.near_duplicates(named).items()] + [(None, None, 0)] * (len(rows) - len(named))
    assert sorted(map(str, map(tuple, ngram_join.op3_ngram_join(spark, sf_dir if where == "sf" else odd).collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op4(spark, sf_dir, odd, where):
    """The same scores from a discriminant written out plainly on the operator's statistics."""
    folder = sf_dir if where == "sf" else odd
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    x = quality.statistics([r.text for r in docs])
    held = np.array([r.doc_id is not None and quality.crc_mod_3(r.doc_id) == 1 for r in docs])
    labels = [(r.doc_id, r.quality) for r in table(spark, folder, "labels").collect() if r.doc_id is not None and r.quality is not None]
    rows = {c: np.array([x[i] for i, r in enumerate(docs) if not held[i] for d, q in labels if d == r.doc_id and q == c]) for c in (0, 1)}
    cov = {c: np.cov(rows[c].T, bias=True) for c in (0, 1)}
    n = {c: len(rows[c]) for c in (0, 1)}
    pooled = sum(n[c] * cov[c] for c in (0, 1)) / sum(n.values())

    def density(c):
        s = 0.5 * cov[c] + 0.5 * pooled + 1e-6 * np.eye(len(pooled))
        gap = x - rows[c].mean(axis=0)
        return -0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap)

    good, bad = density(1), density(0)
    odds = good - bad + np.log(n[1] / n[0])
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in quality.op4_quality(spark, folder).collect()), key=str)
    ids = [(r.doc_id, bool(h)) for r, h in zip(docs, held, strict=True)]
    assert sorted(map(str, ids)) == sorted(str(g[:2]) for g in got) and all(0 <= g[2] <= 1 and g[3] == (g[2] >= 0.5) for g in got)
    if where == "odd":  # a dozen labels leave directions without variance, where huge densities cancel
        return
    known = {}
    for key, o, room in zip(ids, odds, 1e-6 * (abs(good) + abs(bad)) + 1e-6, strict=True):
        known.setdefault(key, []).append((o, room))
    for d, h, score, _ in got:
        clipped = min(max(score, 1e-26), 1 - 1e-15)
        assert any(abs(np.log(clipped / (1 - clipped)) - o) <= room or (abs(o) > 30 and (o > 0) == (score > 0.5)) for o, room in known[d, h])


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op5(spark, sf_dir, odd, where):
    folder = sf_dir if where == "sf" else odd
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, folder, "embeddings").collect() if r.embedding is not None and None not in r.embedding]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    got = {}
    for r in ann.op5_nearest(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [(q, v) for q, v in rows if q % 20 == 0]
    hit = total = 0
    for q, v in asked:
        best = sorted(((-float(w @ v), i) for i, w in rows if i != q and len(w) == len(v)))[:20]
        own = sorted(got.pop(q, []))
        assert [r for r, *_ in own] == list(range(1, len(best) + 1)) and all(abs(s - next(w for i, w in rows if i == d) @ v) < 1e-9 for _, d, s in own)
        hit += len({i for _, i in best} & {d for _, d, _ in own})
        total += len(best)
    assert hit >= 0.9 * total and not got


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op6(spark, sf_dir, odd, where):
    folder, said = sf_dir if where == "sf" else odd, "\\### Assistant: </turn> ok"
    turns = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.op6_chat(spark, folder).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        learned = "".join(t[3] or "" for t in own if t[2] == "assistant")
        digest = hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert got.pop(c) == (len(own), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert not got


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op7(spark, sf_dir, odd, where):
    folder = sf_dir if where == "sf" else odd
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    named = [(-i - 1 if d is None else d, t) for i, (d, t) in enumerate(items)]
    hit, ids = brute.contamination(docs, named), brute.contamination(docs, [x for x in items if x[0] is not None])
    expected = [(docs[i][0], *hit[i][:2], *ids[i][2:4], hit[i][4]) for i in range(len(docs))]
    assert sorted(map(str, map(tuple, decontaminate.op7_decontamination(spark, folder).collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op9(spark, sf_dir, odd, where):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir if where == "sf" else odd, "documents").collect()]
    expected = sorted((str(d), n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute.repeats(docs, 200))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in suffix_dedup.op9_suffix_dedup(spark, sf_dir if where == "sf" else odd).collect()) == expected


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_op10(spark, sf_dir, odd, tokenizer, where):
    folder = sf_dir if where == "sf" else odd
    pieces = packing.op10_packing(spark, folder).collect()
    ids = [[*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in table(spark, folder, "documents").collect()]
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)]).tolist()[:-1]
        assert sum(n for _, n in own) in {2048, *(1 << b for b in range(11))}
    unique = {}
    for r, own in zip(table(spark, folder, "documents").collect(), ids, strict=True):
        unique.setdefault((r.doc_id, len(own)), []).append(own)
    assert set(unique) == set(by_doc)
    for key, docs in unique.items():
        if len(docs) == 1:
            for start, n, crc in by_doc[key]:
                assert zlib.crc32(np.array(docs[0][start : start + n], "<u4").tobytes()) == crc
            assert sum(n for _, n, _ in by_doc[key]) == len(docs[0])


def test_op1(spark, odd):
    got = {r.page_id: tuple(r)[1:] for r in warc.op1_warc(spark, odd).collect()}
    digest = hashlib.sha1(b"x" * 2000).hexdigest()
    long = "é".encode() * 3_000_000
    assert got == {
        1: (0, hashlib.sha1(b"").hexdigest(), "response", None), 4: (0, hashlib.sha1(b"").hexdigest(), "response", None), 2: (2000, digest, "revisit", 3),
        3: (2000, digest, "response", None), None: (2000, digest, "revisit", 3), 5: (len(long), hashlib.sha1(long).hexdigest(), "response", None),
    }


@pytest.fixture(scope="module")
def empty(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in "documents benchmark labels pages embeddings conversations".split():
        table(spark, sf_dir, name).limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", list(SCHEMAS))
def test_empty(spark, empty, name):
    found = registry.queries()[name](spark, empty)
    assert kinds(found) == SCHEMAS[name] and found.count() == (1 if name == "op6_chat" else 0)  # conversation -7


@pytest.mark.parametrize("where", ["odd", "empty"])
def test_stages(spark, odd, empty, where):
    """Stages take nulls, repeated rows and clashing columns, and pass on the columns of their input."""
    folder = odd if where == "odd" else empty
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        assert (found.count() > 0) == (where == "odd")
    scored = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert scored.columns == docs.columns and scored.count() <= docs.count()
    packed = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(packed.columns) and (packed.count() > 0) == (where == "odd")


def test_clashing_names(spark, odd):
    """A column with the name of a new one is replaced; all others pass through."""
    docs = table(spark, odd, "documents")
    found = suffix_dedup.remove_repeats(docs.withColumn("n_spans", F.lit("x")), digest=True)
    assert dict(found.dtypes)["n_spans"] == "bigint" and dict(found.dtypes)["n_bytes"] == "bigint" and "row" in found.columns and found.count() == docs.count()
    judged = decontaminate.judge(docs, table(spark, odd, "benchmark"), matches="score")
    assert dict(judged.dtypes)["contaminated"] == "boolean" and dict(judged.dtypes)["score"].startswith("array") and judged.where("n_words is null").count() == 0
    scored = quality.score(docs, quality.QualityModel(None, None, 0.0), "text")
    assert {r.score for r in scored.collect()} == {0.5}
    assert line_dedup.remove_repeated_chunks(docs).count() == docs.count()


def test_different_texts_of_equal_polynomials(spark):
    """Thue-Morse words: no polynomial hash modulo 2**64 with an odd base tells these texts apart."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, " ".join("ab"[b] for b in bits)), (2, " ".join("ba"[b] for b in bits))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same = [bytes(r.same) for r in docs.select("doc_id", "text").mapInArrow(ngram_join._signed(5), "doc_id long, same binary, n_words long, sig binary, keys array<long>").collect()]
    assert same[0] != same[1]
    expected = {rows[i][0]: x for i, x in brute.near_duplicates(rows).items()}
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()} == expected


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_suffix_dedup_of_hot_and_long(spark, odd, monkeypatch, hot):
    """Hot anchors travel as windows, long texts over several runs; nothing changes."""
    for name, value in (("RUN", 97), ("SHARD", 20_000), ("BATCH", 50), ("BLOCK", 4096)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = [(r.doc_id, r.text) for r in table(spark, odd, "documents").where("doc_id is not null").collect()]
    rows += [(100 + i, rows[0][1] + f" x{i} " + rows[1][1][:150] + rows[2][1]) for i in range(40)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=60, hot=hot)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())
    assert got == sorted(brute.repeats(rows, 60))
