"""WARC, token shards, nearest neighbours, chat windows, packing and the pipeline."""

import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from searchloom.llm import ann, bpe, chat, packing, registry, tokenfile, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*"ab \n\t.,'#-1é×’　\xa0 😀\x85\x1c|<>_日", "'s", "<|endoftext|>", " ", "Dieüauß ", "ciónmente, "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_encoder_equals_the_library(library):
    texts = [None, "", *odd_texts(3000), "word " * 20_000]
    ids, at = bpe.encoder(BPE).encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_encoder_with_a_small_table(library):
    small = bpe.Encoder(BPE, entries=64)
    texts = odd_texts(300, 2)
    ids, at = small.encode(texts)
    assert all(ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


@pytest.mark.parametrize("bits", [1, 3, 7, 11, 16, 17, 24, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = tokenfile.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    for skip, count in ((0, 1001), (5, 17), (1000, 1), (3, 0)):
        assert tokenfile.unpack(data, bits, skip, count).tolist() == ids[skip : skip + count].tolist()


def test_token_shards(spark, library):
    texts = odd_texts(50) + ["long word " * 5000]
    rows = [(i * 3 % 17, t) for i, t in enumerate(texts)] + [(None, "x"), (99, None), (100, ""), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    manifest = tokenfile.write_tokens(docs, BPE, 0)
    found = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, at = [], 0
    for d, t in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((d, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in found if r.doc_id is not None) == sorted(x for x in expected if x[0] is not None)
    assert [r.doc_id for r in found] == [x[0] for x in expected]
    shard = tokenfile.ShardReader(manifest.first().file)
    assert shard.ids(3, 5).tolist() == np.concatenate([ids for _, _, ids in shard.documents()])[3:8].tolist()
    assert tokenfile.read_tokens(tokenfile.write_tokens(docs.limit(0), BPE, 0)).count() == 0


def pages(spark):
    big, small = "<p>é</p>" * 200, "<p>small</p>"
    rows = [(1, "http://a.example.org/x?q=1", big), (2, "https://b.example.org/", big), (9, "http://a.example.org/x?q=1", big), (9, "http://a.example.org/x?q=1", big)]
    rows += [(3, None, small), (4, "not a url", small), (5, "http://c.org:8080/é b", None), (6, "http://c.org", ""), (None, "http://d.org", big)]
    rows += [(100 + i, f"http://host{i % 7}.net/p{i}", f"{i}" * 400) for i in range(60)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


def test_warc(spark):
    rows, df = pages(spark)
    directory = warc.write_archives(df)
    found = warc.read_archives(directory).collect()
    expected = []
    for page, url, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        keeper = max(same) if len(raw) >= 1000 and same else page
        revisit = len(raw) >= 1000 and keeper != page
        expected.append((page, url, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, expected))
    for url in ("http://a.example.org/x?q=1", "http://c.org:8080/é b", "http://none.org/"):
        assert sorted(map(str, warc.lookup(directory, url))) == sorted(str(x) for x in expected if x[1] == url)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_lookup_bisects(spark, monkeypatch):
    """Blocks are found in sorted keys that are read once; a key of many blocks is read on the executors."""
    monkeypatch.setattr(warc, "BLOCK", 4)
    rows = [(i, None if i % 3 == 0 else f"http://host{i % 11}.net/p{i % 50}", f"{i}" * 9) for i in range(300)]
    directory = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    lines = directory.collect()
    keys = {warc.url_key(u) for _, u, _ in rows} | {"net", "net,host5)/p7x", "zz"}
    for key in keys:
        assert sorted(warc.blocks_of(directory, key)) == sorted((r.file, r.start, r.length) for r in lines if r.first_key <= key <= r.last_key)
    monkeypatch.setattr(directory, "where", None)
    monkeypatch.setattr(directory, "toLocalIterator", None)
    assert len(warc.blocks_of(directory, "")) >= 25
    without = warc.read_url(directory, None)
    assert without.rdd.getNumPartitions() > 1 and sorted(r.page_id for r in without.collect()) == [i for i, u, _ in rows if u is None]
    for url in (rows[1][1], rows[200][1], "http://host5.net/p7x"):
        assert sorted(x[0] for x in warc.lookup(directory, url)) == [i for i, u, _ in rows if u == url]


def test_warc_keys():
    assert warc.url_key("https://www.Example.org:443/a?b") == "org,example,www)/a?b"
    assert warc.url_key("http://x.org:81") == "org,x:81)/" and warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    v[10:400] = v[10]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [float("inf")] * 16), (5005, [1.0]), (None, [1.0] * 16), (7, v[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    found = ann.nearest(table, table.where("vec_id % 20 = 0"), 20)
    by = {}
    for r in found.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.append(np.arange(3000), 7)
    data = np.vstack((v, v[7]))
    hit = total = 0
    for q in range(0, 3000, 20):
        got = sorted(by[q])
        assert [r for r, _, _ in got] == list(range(1, 21)) and [s for *_, s in got] == sorted((s for *_, s in got), reverse=True)
        assert all(abs(s - v[q] @ v[i]) < 1e-9 for _, i, s in got) and q not in [i for _, i, _ in got]
        score = np.einsum("ij,j->i", data, v[q])
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        hit += len({int(ids[i]) for i in best} & {i for _, i, _ in got})
        total += len({int(ids[i]) for i in best})
    assert hit >= 0.9 * total and set(by) == set(range(0, 3000, 20))
    few = table.where("vec_id < 3")
    assert {(r.query_id, r.vec_id) for r in ann.nearest(few, few, 20).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert ann.nearest(table.limit(0), table, 5).count() == 0


def test_chi_square():
    x = np.random.default_rng(0).chisquare(8, 20_000)
    for q in (0.1, 0.5, 0.9):
        assert abs(ann.chi_square(float(np.quantile(x, q)), 8) - q) < 0.02


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(6)
    odd = ["\\### Assistant: </turn> ok", " </turn>\n### user: x", "\\b\\h\\l\\c", "", None, "é😀" * 30, "a: b # < \\", "\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "a:b\n", None, "system"]), rng.choice(odd) if rng.random() < 0.4 else "w " * rng.randrange(900)) for c in range(8) for t in range(rng.randrange(1, 30))]
    rows += [(50, t, "system" if t == 0 else "assistant" if t % 2 else "user", "said " * 20 + str(t)) for t in range(400)]
    rows += [(60, 0, "assistant", "x" * 20_000), (60, 1, "assistant", "tie"), (60, 1, "assistant", "tie"), (60, None, "user", "null turn"), (None, 0, "user", "nobody's")]
    return rows


def test_chat(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, CONVERSATIONS).withColumn("chunk", F.lit(1))
    found = chat.windows(turns)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.conv_id: r for r in chat.digests(found).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for w in found.collect():
        assert len(w.formatted) == w.size and (w.size <= chat.SYSTEM + chat.HISTORY + chat.NEW or w.n_new == 1)
        assert w.n_context <= chat.HISTORY_TURNS + 1
    long = [w for w in found.collect() if w.conv_id == 50]
    assert all(w.formatted.startswith("### system: said") for w in long) and sum(w.n_new for w in long) == 400 and max(w.n_context for w in long) == 3


def test_chat_keeps_long_system_turn(spark):
    """A system turn longer than its part of the budget leads every window of every chunk."""
    prompt = "rule #1 " * 400
    rows = [(1, 0, "system", prompt)] + [(1, i, "assistant" if i % 2 else "user", f"said {i} " * 60) for i in range(1, 150)]
    found = chat.windows(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert len({w.chunk for w in found}) == 3 and all(sum(w.chunk == c for w in found) > 1 for c in range(3))
    shown = "### system: " + prompt.replace("#", "\\h") + chat.END
    assert len(shown) > chat.SYSTEM and all(w.formatted.startswith(shown) and w.formatted.count("### system: ") == 1 for w in found)
    assert all(len(w.formatted) == w.size <= len(shown) + chat.HISTORY + chat.NEW for w in found) and sum(w.n_new for w in found) == len(rows)


def test_chat_of_nothing(spark):
    assert chat.digests(chat.windows(spark.createDataFrame([], CONVERSATIONS))).count() == 0


def check_pieces(rows, pieces, library, end=1, length=packing.LENGTH):
    """Every id of every (doc_id, text) lies in exactly one piece; sequences are gapless and never padded."""
    left = {}
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        left.setdefault((d, len(ids)), []).append(ids)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    assert by_doc.keys() == left.keys()
    for key, own in by_doc.items():
        if len(left[key]) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(left[key][0][at : at + p.length].tobytes())
                at += p.length
            assert at == key[1]
        else:
            assert sum(p.length for p in own) == sum(map(len, left[key]))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(sequences) == set(range(len(sequences)))
    sizes = []
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert all(s <= length and (s == length or s & (s - 1) == 0) for s in sizes)
    return sequences


def test_packing(spark, library):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(("rain", "sun", "Zu", "ciónmente")) for _ in range(rng.randrange(400)))) for i in range(150)] + [(200, None), (201, ""), (None, "x y"), (7, "again"), (202, "long " * 30_000)]
    names = ["hot"] * 4 + ["b", "c", None]
    docs = spark.createDataFrame([(*r, names[i % 7]) for i, r in enumerate(rows)], "doc_id long, text string, source string").withColumn("offset", F.lit(0)).repartition(5)
    pieces = packing.pack(docs, BPE, span=8, digest=True).collect()
    sequences = check_pieces(rows, pieces, library)
    total = {}
    for p in pieces:
        total[p.source] = total.get(p.source, 0) + p.length
    for own in sequences.values():
        if sum(p.length for p in own) == packing.LENGTH:
            for s, n in total.items():
                assert abs(sum(p.length for p in own if p.source == s) - n / sum(total.values()) * packing.LENGTH) < 3
    even = packing.pack(docs, BPE, span=8, mixture={"hot": 1.0, "b": 1.0, "c": 1.0}, digest=True).collect()
    first = [p for p in even if p.sequence_id == 0]
    check_pieces(rows, even, library)
    assert all(abs(sum(p.length for p in first if p.source == s) - packing.LENGTH / 3) < 3 for s in ("hot", "b", "c"))
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_plan_is_monotone():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice((0, 1, 3, 500, 80_000)) * rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))]
        plan = packing.Plan(sizes, 64, 4)
        for s, n in enumerate(sizes):
            bounds = [plan.bound(s, g) for g in range(plan.groups + 1)]
            assert bounds == sorted(bounds) and bounds[0] == 0 and bounds[-1] == n
        for g in range(plan.groups - 1):
            assert sum(plan.bound(s, g + 1) - plan.bound(s, g) for s in range(len(sizes))) == plan.width


def test_pipeline(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns
        old, new = ([(r.doc_id, r.text) for r in sorted(df.collect(), key=lambda r: r.doc_id)] for df in (before, after))
        if i == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            assert set(new) <= set(old)
            kept = {d for d, _ in new}
            assert sum((d in kept) == (labels[d] == 1) for d, _ in old if d in labels) >= 0.9 * sum(d in labels for d, _ in old)
        elif i == 1:
            assert new == [(d, t) for d, t, _ in brute.line_dedup(old)]
        elif i == 2:
            near = brute.near_duplicates(old)
            assert new == [x for k, x in enumerate(old) if near[k][0] == x[0]]
        else:
            bad = brute.contamination(old, items)
            assert new == [x for k, x in enumerate(old) if not bad[k][-1]]
        before = after
    pieces = corpus_pipeline.STAGES[4][1](spark, before, sf_dir).collect()
    check_pieces([(r.doc_id, r.text) for r in before.collect()], pieces, library)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(pieces)


def test_queries_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        found = registry.queries()[name](spark, sf_dir)
        relation = con.sql(sql)
        order = [relation.columns.index(c) for c in found.columns]
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in relation.fetchall())
