"""Operators on small tables: nulls, empty and long texts, ties, repeated
rows, empty tables and clashing extra columns, against brute force."""

import random
import re
import shutil
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlstrata.llm import chaining, langid, mixing, neardup, packing, rangecoder, topk, toxicity, triejoin, warc
from sqlstrata.llm.common import connected_components, scratch, written
from sqlstrata.llm.tokens import public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t):
    return WORD.findall(lower(t))


def make_texts(seed, n=60):
    """Random texts with near copies, exact copies and shared passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(4000)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = say(80)
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.3 and out:
            w = r.choice(out).split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
        elif kind < 0.5:
            out.append(say(r.randint(5, 60)) + ".\n" + passage + " " + say(r.randint(5, 60)))
        elif kind < 0.6 and out:
            out.append(r.choice(out))
        else:
            out.append(say(r.randint(1, 150)))
    return out


def documents(spark, extra=(), seed=1, n=60):
    rows = [(i * 3, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(make_texts(seed, n))]
    rows += [(1000, None, None, None, None), (1001, "", "de", "src0", 0), (1002, " \n\t", None, "src1", 3),
             (1003, "word " * 30_000, "en", None, 150_000), (None, "no id at all here", "en", "src2", 17),
             (1004, "Five WORDS are here now", "en", "Ünique", 23), (1005, "five words ARE here now", "en", "src2", 23),
             (1006, "two words", "en", "src2", 9)]
    rows += list(extra)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    # names that operators use inside
    for c in ("score", "size", "h", "doc", "n", "k1", "copies", "component_id", "start", "words", "class_id", "pos"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- components


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    edges += [(5000, 5000 + i) for i in range(1, 200)] + [(None, 3), (4, None), (7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    par = {}

    def find(v):
        par.setdefault(v, v)
        while par[v] != v:
            v = par[v]
        return v
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            par[b] = a
    assert got == {v: find(v) for v in par}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1: token files


def test_token_files(spark):
    from tokenizers import Tokenizer

    df = documents(spark, [(3, "Once more", "en", "src0", 9), (3, "Once more", "en", "src0", 9)])
    path = scratch(spark, "t")
    rangecoder.write_tokens(df, path, public_path("word_bpe_49k.json"), end_id=2)
    got = rangecoder.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    tok = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    rows = sorted(((x.doc_id, x.text) for x in df.select("doc_id", "text").collect()),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    at = 0
    assert len(got) == len(rows)
    for g, (d, t) in zip(got, rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (d, at, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    path = scratch(spark, "t")
    rangecoder.write_tokens(empty(spark), path, public_path("word_bpe_49k.json"), end_id=2)
    assert rangecoder.read_tokens(spark, path).count() == 0


# ---------------------------------------------------------------- 2: toxicity


def test_toxicity(spark):
    r = random.Random(8)
    vocab = [f"wort{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(300):
        s = [" ".join(r.choice(vocab) for _ in range(9)) for _ in range(r.randint(1, 7))]
        if i % 5 == 0:
            s[r.randrange(len(s))] += " snarfel" + r.choice(["", "t", "ig"])
        rows.append((i, ". ".join(s)))
        labels.append((i, int(i % 5 == 0)))
    labels += [(None, 1), (2, None), (900, 1), (5, 1), (5, 0)]
    docs = spark.createDataFrame(rows + [(400, None), (401, ""), (None, "snarfelig"), (0, rows[0][1])], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.train(docs, lab)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 304 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    held = [x for x in got if x.doc_id is not None and x.doc_id < 300 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert held and sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)
    by = {x.doc_id: x for x in got}
    assert by[400].score == by[401].score == 0 and by[None].predicted == 1
    texts = dict(rows)
    for x in held:
        if x.predicted and x.doc_id % 5 == 0:
            assert any("snarfel" in texts[x.doc_id][p.start:p.end] for p in x.spans)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted == 0 for x in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    blank = toxicity.train(docs, lab.limit(0))
    assert all(x.predicted == 0 for x in toxicity.score(docs, blank).collect())


# ---------------------------------------------------------------- 3: archives


def test_warc(spark):
    import base64
    import hashlib

    rows = [(1, "http://a.example/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "http://b/", "<p>é</p>"), (4, "", None), (5, "u", ""),
            (6, "http://c/", "WARC/1.1\r\n\r\n" * 50), (7, "http://d/", "x" * 300_000), (None, "http://e/", "<p>é</p>"), (8, "x\ny", "tiny")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    for least, last in ((0, {"<p>é</p>": 9, "": 5}), (5, {"<p>é</p>": 9})):
        out = scratch(spark, "warc")
        warc.write_warc(warc.pages_to_arc(df), out, min_bytes=least)
        got = {x.key: x for x in warc.read_warc(spark, out).collect()}
        assert set(got) == {x[0] for x in rows}
        for key, _, page in rows:
            raw = (page or "").encode()
            x, keeper = got[key], last.get(page or "")
            assert (x.payload_bytes, x.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            again = keeper is not None and keeper != key
            assert (x.record_type, x.refers_to) == (("revisit", keeper) if again else ("response", None))
    out = scratch(spark, "warc")
    warc.write_warc(warc.pages_to_arc(df.limit(0)), out)
    assert warc.read_warc(spark, out).count() == 0


# ---------------------------------------------------------------- 4: language


def test_language(spark):
    train = [(i, t, l, "s", 0) for i, (t, l) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze im haus", "de"),
                                                             ("le chien et le chat de la maison", "fr")] * 5)]
    docs = spark.createDataFrame(train + [(90, None, "en", "s", 0), (91, "x", None, "s", 0)], DOCS)
    pages = [(1, "https://a.example.de/1", '<html lang="en"><script>the the the</script><p>der hund und die katze im haus der hund</p>'),
             (2, None, "<p>the dog of the house and the cat</p>"), (3, "http://[bad", None), (4, "http://a.example.de/2", ""),
             (5, "http://b.example.de/", '<html lang="de-AT"><p>die katze &amp; der hund</p>'), (None, "http://c.fr", "<p>le chat et la maison</p>"),
             (6, "http://a.example.de/3", "<p>der hund im haus</p>"), (6, "http://a.example.de/3", "<p>der hund im haus</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = langid.identify(df, docs).collect()
    by = {x.page_id: x for x in got}
    assert len(got) == 8 and by[1].lang == "de" and by[1].declared == "en" and by[1].suffix == "de"
    assert by[2].lang == "en" and by[None].lang == "fr" and by[5].declared == "de" and by[5].lang == "de"
    assert by[4].lang == "de" and by[4].text_lang is None  # the host decides
    assert by[3].text_lang is None and by[3].host is None and by[3].lang is not None
    assert all(abs(sum(x.probs) - 1) < 1e-9 for x in got)
    assert langid.identify(df.limit(0), docs).count() == 0
    assert {x.lang for x in langid.identify(df, docs.limit(0)).collect()} == {None}


def test_language_host_prior_is_smoothed_sums(spark):
    """The host prior of a page, recomputed from the other pages' text alone."""
    docs = spark.createDataFrame([(0, "aaa bbb aab", "x", "s", 0), (1, "ccc ddd ccd", "y", "s", 0)], DOCS)
    pages = [(i, f"http://h{i % 2}.d{i % 3}.org/{i}", f"<p>{'aaa bbb' if i % 3 else 'ccc ddd'}</p>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    langs, model = langid.train(docs)
    ev = langid._evidence(df, langs, model).collect()
    r = {}
    for x in ev:
        e = np.exp(np.array(x.ll) - max(x.ll))
        r[x.page_id] = (e / e.sum(), x.host, x.domain)
    overall = (sum(v[0] for v in r.values()) + 1) / (len(r) + 2)
    for x in langid.identify(df, docs).collect():
        own, host, dom = r[x.page_id]
        d = [v[0] for k, v in r.items() if v[2] == dom and k != x.page_id]
        h = [v[0] for k, v in r.items() if v[1] == host and k != x.page_id]
        p = (sum(d, np.zeros(2)) + langid.ALPHA * overall) / (len(d) + langid.ALPHA)
        p = (sum(h, np.zeros(2)) + langid.ALPHA * p) / (len(h) + langid.ALPHA)
        assert abs(x.host_prior - p[langs.index(x.lang)]) < 1e-9


# ---------------------------------------------------------------- 5: top-k


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    r = np.random.default_rng(5)
    base = r.standard_normal((6, 12)).astype(np.float32)
    vec = [(base[i % 6] + 0.2 * r.standard_normal(12).astype(np.float32)).tolist() for i in range(300)]
    rows = list(enumerate(vec)) + [(1000 + i, vec[0]) for i in range(30)]  # ties
    rows += [(2000, None), (2010, [1.0] * 11 + [None]), (2020, [float("nan")] * 12), (2030, [float("inf")] + [1.0] * 11), (2040, []),
             (None, vec[3]), (2050, [0.0] * 12), (2060, [1.0, 2.0]), (5, vec[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(4)
    got = defaultdict(list)
    for x in sorted(topk.top_k(df, k=10, every=10, pivots=5).collect(), key=lambda x: (x.query_id, x["rank"])):
        assert x["rank"] == len(got[x.query_id]) + 1
        got[x.query_id].append((x.vec_id, x.score))
    good = {i: np.floor(1024 * np.array(v, np.float64)) for i, v in rows if i is not None and v and len(v) == 12 and None not in v and np.isfinite(v).all()}
    ids = np.array(sorted(good))
    mat = np.array([good[i] for i in ids])
    for q in ids[ids % 10 == 0]:
        s = mat @ good[q]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:10]
        assert got.pop(int(q)) == [(int(ids[j]), int(s[j])) for j in best]
    assert got.pop(2060, []) == [] and not got
    assert topk.top_k(df.limit(0)).count() == 0
    few = topk.top_k(df.filter("vec_id < 4"), every=2).collect()
    assert len(few) == 6


# ---------------------------------------------------------------- 6: n-gram join


def brute_join(rows):
    sets, groups = {}, defaultdict(list)
    for d, t in rows:
        w = words(t)
        s = frozenset([tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))
        if d is not None:
            sets.setdefault(d, []).append(s)
    par = {d: d for d in sets}

    def find(v):
        while par[v] != v:
            v = par[v]
        return v
    flat = [(d, s) for d, ss in sets.items() for s in ss if s]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                par[q] = p
    return {d: ([len(s) for s in ss], find(d)) for d, ss in sets.items()}


@pytest.mark.parametrize("seed,block,ranges", [(1, 256, 18), (3, 2, 2)])
def test_ngram_join(spark, monkeypatch, seed, block, ranges):
    """Also with tiny blocks and so few ranges that many are frequent."""
    monkeypatch.setattr(triejoin, "BLOCK", block)
    monkeypatch.setattr(triejoin, "TILE_ROWS", 16 if block == 2 else triejoin.TILE_ROWS)
    real = triejoin.frequent_ranges
    monkeypatch.setattr(triejoin, "frequent_ranges", lambda d, h: real(d, h, ranges))
    df = documents(spark, [(6, "five words are here now", "x", "y", 1), (1010, None, None, None, None)], seed, 90)
    got = triejoin.similarity_components(df).collect()
    want = brute_join([(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()])
    assert len(got) == df.count()
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert x.n_shingles in want[x.doc_id][0] and x.component_id == want[x.doc_id][1], x
    if seed == 1:
        assert triejoin.similarity_components(empty(spark)).count() == 0


def test_ngram_join_of_a_large_family(spark):
    """A family whose members differ from the smallest one too much to link
    with it, but link in a row."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:100 - 4 * i] + [f"z{j}" for j in range(4 * i)]), "en", "s", 0) for i in range(12)]
    rows += [(100 + i, " ".join([f"u{i}"] + base), "en", "s", 0) for i in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    want = brute_join([(x[0], x[1]) for x in rows])
    for x in triejoin.similarity_components(df).collect():
        assert x.component_id == want[x.doc_id][1]


# ---------------------------------------------------------------- memory of the workers


def python_steps(plan):
    """The most Python steps of one stage below a plan node, and in the stage it belongs to."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return python_steps(plan.initialPlan())
    kids = [plan.children().apply(i) for i in range(plan.children().size())]
    below = [python_steps(x) for x in kids]
    most, here = max((x[0] for x in below), default=0), max((x[1] for x in below), default=0)
    here = 0 if "Exchange" in name else here + (name == "MapInArrow")
    return max(most, here), here


def test_a_stage_holds_one_python_step(spark, monkeypatch):
    """Small sides of joins are not broadcast between two Python steps: a task would hold two workers."""
    seen = []

    def noting(df, name):
        seen.append((name, python_steps(df._jdf.queryExecution().executedPlan())[0]))
        return written(df, name)

    monkeypatch.setattr(triejoin, "written", noting)
    monkeypatch.setattr(chaining, "written", noting)
    say = " ".join
    base = [f"w{i}" for i in range(100)]
    rows = [(i, say([f"u{i}", *base]), "en", "s", 0) for i in range(6)] + [(10 + i, say(f"x{i}y{j}" for j in range(60)), "en", "s", 0) for i in range(4)]
    df = spark.createDataFrame(rows, DOCS)
    found = triejoin.similarity_components(df)
    assert found.filter("component_id = 0").count() == 6
    passages = written(chaining.repeated_passages(df), "found")
    assert passages.count() == 5
    out = chaining.without_passages(df, passages)
    seen.append(("cut", python_steps(out._jdf.queryExecution().executedPlan())[0]))
    assert {x.doc_id: x.text for x in out.collect()}.keys() == {x[0] for x in rows}
    assert {"verified", "passages", "cut"} <= {x[0] for x in seen}
    assert [x for x in seen if x[1] > 1] == []


def test_packing_leaves_no_encoder_in_a_worker(spark, tmp_path):
    """A worker goes on with other stages: vocabulary and chunks must not stay with it."""
    def held(batches):
        import pyarrow as pa

        from sqlstrata.llm import tokens
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([own in tokens._ENCODERS])], names=["there"])

    df = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    own = shutil.copy(public_path("byte_bpe_50k.json"), str(tmp_path / "own.json"))  # no other test uses this file
    assert packing.pack(df, own, end_id=1).select("doc_id").distinct().count() == 40
    assert {x.there for x in df.repartition(64).mapInArrow(held, "there boolean").collect()} == {False}


# ---------------------------------------------------------------- 7: packing


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP_IDS", 5000)
    df = documents(spark)
    got = packing.pack(df, public_path("byte_bpe_50k.json"), end_id=1, with_ids=True).collect()
    tok = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    ids = {x.doc_id: tok.encode(x.text or "", add_special_tokens=False).ids + [1] for x in df.select("doc_id", "text").collect()}
    parts, seqs = defaultdict(list), defaultdict(list)
    for x in got:
        piece = ids[x.doc_id][x.start:x.start + x.length]
        assert x.ids == piece and x.doc_tokens == len(ids[x.doc_id])
        assert x.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        parts[x.doc_id].append((x.start, x.length))
        seqs[x.sequence_id].append((x.offset, x.length))
    assert set(parts) == set(ids)
    for d, v in parts.items():
        assert sum(n for _, n in v) == len(ids[d]) and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:]))
    for v in seqs.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:]))
        total = sum(n for _, n in v)
        assert total == 2048 or (total < 2048 and total & (total - 1) == 0)
    assert packing.pack(empty(spark), public_path("byte_bpe_50k.json"), end_id=1).count() == 0


# ---------------------------------------------------------------- 8: near-duplicate vectors


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = np.random.default_rng(6)
    rows = []
    for i in range(250):
        if i % 3 == 0 or i < 5:
            v = r.standard_normal(16)
        else:
            v = np.array(rows[r.integers(0, len(rows))][1]) + r.choice([0, 0.05, 0.12]) * r.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2) if i % 7 else 5))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, [], 1),
             (405, rows[0][1], None), (None, rows[0][1], rows[0][2]), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (300, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash")).repartition(4)
    got = neardup.near_duplicates(df).collect()
    fine = [(i, np.array(v, np.float64), l) for i, v, l in rows if i is not None and l is not None and v and None not in v
            and np.isfinite(v).all() and np.any(v)]
    links, par = defaultdict(list), {x[0]: x[0] for x in rows if x[0] is not None}

    def find(v):
        while par[v] != v:
            v = par[v]
        return v
    count = [0] * len(fine)
    for i, (a, x, l) in enumerate(fine):
        for j, (b, y, m) in enumerate(fine[:i]):
            if l == m and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                count[i] += 1
                count[j] += 1
                p, q = sorted((find(a), find(b)))
                par[q] = p
    for c, (a, _, _) in zip(count, fine):
        links[a].append(c)
    total = sum(count)
    assert len(got) == len(rows) and sum(x.n_links for x in got) >= 0.97 * total
    same = 0
    for x in got:
        if x.vec_id is None:
            assert x.n_links == 0 and x.component_id is None and not x.kept
            continue
        assert x.n_links <= max(links.get(x.vec_id, [0])) and x.kept == (x.vec_id == x.component_id)
        same += x.component_id == find(x.vec_id)
        if x.vec_id >= 400 and x.vec_id < 406:
            assert x.n_links == 0 and x.component_id == x.vec_id
    assert same >= 0.97 * len(got)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9: mixing


def brute_targets(size):
    """Targets by repeated resharing."""
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            return {**{s: 3.0 * size[s] for s in full}, **share}
        full |= over


def test_mixing(spark):
    df = documents(spark, [(i, f"w{i} " * (i % 7 + 1), "en", "hot", 5) for i in range(2000, 2600)], n=120)
    got = mixing.mix(df).collect()
    rows = df.select("doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    size, taken = defaultdict(int), defaultdict(int)
    for x in rows:
        size[x.source] += len(WORD.findall(x.text or ""))
    want = brute_targets(size)
    per = {(x.doc_id, x.source): len(WORD.findall(x.text or "")) for x in rows}
    for x in got:
        assert x.size == per[(x.doc_id, x.source)] and x.source_size == size[x.source] and abs(x.target - want[x.source]) < 1e-6
        assert 0 <= x.copies <= 3
        taken[x.source] += x.copies * x.size
    assert abs(taken["hot"] - want["hot"]) <= 1
    for s in size:
        longest = max(n for (d, q), n in per.items() if q == s)
        assert abs(taken[s] - want[s]) <= max(1, longest)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.source or "", x.copies)
    assert sorted(got, key=key) == sorted(again, key=key)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    n = defaultdict(int)
    for x in out.select("doc_id", "source").collect():
        n[(x.doc_id, x.source)] += 1
    assert all(n[(x.doc_id, x.source)] == x.copies for x in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_mixing_splits_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)
    rows = [(i, "one two three", "en", "a" if i % 4 else "b", 0) for i in range(800)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    for s, want in brute_targets({"a": 1800, "b": 600}).items():
        assert abs(sum(x.copies * x.size for x in got if x.source == s) - want) <= 3


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 1, lambda i: i % 3, lambda i: None if i % 2 else i])
@pytest.mark.parametrize("text", [lambda i: "one two three", lambda i: f"a b w{i}"])
def test_mixing_without_usable_ids(spark, ids, text):
    """Rows without an id, of one id, and equal rows: the target is met to a document."""
    rows = [(ids(i), text(i), "en", "a", 0) for i in range(300)] + [(5000 + i, "x " * 9, "en", "b", 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    want = brute_targets({"a": 900, "b": 2700})
    got = mixing.mix(df).collect()
    taken = {s: sum(x.copies * x.size for x in got if x.source == s) for s in want}
    assert all(abs(taken[s] - want[s]) <= 9 for s in want) and len(got) == 600 and all(0 <= x.copies <= 3 for x in got)
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.source or "", x.copies)
    assert sorted(mixing.mix(df.repartition(3)).collect(), key=key) == sorted(got, key=key)
    out = mixing.mixed(df)
    n = {r.source: r["sum(n)"] for r in out.withColumn("n", F.size(F.split(F.trim("text"), " "))).groupBy("source").sum("n").collect()}
    assert n == taken


def test_mixing_with_clashing_columns(spark):
    names = ("target", "rounds", "upto", "source_size", "size", "u", "copies", "_s", "_l", "_row", "_copies", "last", "ties", "n m")
    df = documents(spark, n=30)
    more = df.select("*", *[F.lit(c).alias(c) for c in names if c not in df.columns])
    assert mixing.mixed(more).columns == more.columns
    plain, wide = mixing.mixed(df).collect(), mixing.mixed(more).select(*df.columns).collect()
    assert sorted(map(str, plain)) == sorted(map(str, wide)) and sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, mixing.mix(more).collect()))


def test_fitting_reaches_large_budgets_exactly():
    r = np.random.default_rng(3)
    length = np.unique(r.integers(1, 20_000, 3000))
    count = r.integers(1, 5, len(length))
    budget = int((length * count).sum()) // 2 + 1
    take = mixing.fit_counts(length, count, budget)
    assert (take * length).sum() == budget and (take >= 0).all() and (take <= count).all()


# ---------------------------------------------------------------- 10: passages


def test_passages(spark):
    r = random.Random(12)
    vocab = [f"v{i}" for i in range(5000)]
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, common = say(70), say(120)
    fuzzy = list(passage)
    fuzzy[20] = "changed"
    del fuzzy[45]
    docs = {1: say(40) + passage + say(30), 2: say(55) + passage + say(10), 3: fuzzy + say(60), 4: say(200), 5: say(10) + passage[:40] + say(10),
            6: say(90), 9: say(20) + [w.upper() for w in passage] + say(5) + passage}
    rows = [(d, " ".join(w), "en", "s", 0) for d, w in docs.items()]
    rows += [(7, " ".join(docs[6]), "en", "s", 0), (8, " ".join(docs[5]), "en", "s", 0), (2, rows[1][1], "en", "s", 0)]
    rows += [(100 + i, " ".join(say(30) + common + say(20)), "en", "s", 0) for i in range(60)]
    rows += [(200, None, None, None, None), (201, "", None, None, 0), (None, " ".join(passage), "en", "s", 0), (202, "short", "en", "s", 5)]
    df = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("clash")).repartition(6)
    got = defaultdict(list)
    for x in chaining.repeated_passages(df).collect():
        got[x.doc_id].append((x.start, x.end, x.owner_id))
    assert set(got) == {2, 3, 7, 8, 9} | {100 + i for i in range(1, 60)}

    def near(x, s, e, owner):  # an equal word or two may stand beside a passage by chance
        return x[2] == owner and abs(x[0] - s) <= 2 and abs(x[1] - e) <= 2
    assert near(got[2][0], 55, 125, 1) and near(got[3][0], 0, 69, 1) and got[7] == [(0, 90, 6)] and got[8] == [(0, 60, 5)]
    assert len(got[9]) in (1, 2) and min(got[9])[0] <= 20 and max(got[9], key=lambda x: x[1])[1] == 165
    assert all(near(got[100 + i][0], 30, 150, 100) for i in range(1, 60))
    plain = spark.createDataFrame(rows, DOCS)
    out = {x.doc_id: x.text for x in chaining.without_passages(plain, chaining.repeated_passages(plain)).collect()}
    assert 7 not in out and 8 not in out and out[4] == " ".join(docs[4]) and out[200] is None and out[201] == "" and out[5] == " ".join(docs[5])
    assert len(words(out[2])) == 65 and len(words(out[150])) == 50
    assert chaining.repeated_passages(empty(spark)).count() == 0
    assert chaining.without_passages(empty(spark), chaining.repeated_passages(empty(spark))).count() == 0


def test_every_long_exact_repeat_is_found(spark):
    df = documents(spark, seed=21, n=80)
    rows = sorted((x.doc_id, words(x.text)) for x in df.select("doc_id", "text").collect() if x.doc_id is not None and x.doc_id != 1003)
    first, covered = {}, defaultdict(set)
    for d, w in rows:
        for i in range(len(w) - 49):
            k = tuple(w[i:i + 50])
            if first.setdefault(k, d) < d:
                covered[d].update(range(i, i + 50))
    got = defaultdict(set)
    for x in chaining.repeated_passages(df).collect():
        got[x.doc_id].update(range(x.start, x.end))
    # where the first occurrence differs from a later one, a word at the edge may be left
    assert covered and all(len(c - got[d]) <= 2 for d, c in covered.items())


def edited(r, passage, say, replaced, shifted=0.0):
    out = []
    for w in passage:
        u = r.random()
        if u < replaced:
            out += say(1)
        elif u < replaced + shifted:
            out += [w, *say(1)] if r.random() < 0.5 else []
        else:
            out.append(w)
    return out


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [max(row[j + 1], row[j] + (x == y)) for j, y in enumerate(b)]
        for j in range(len(b)):
            row[j + 1] = max(row[j + 1], row[j])
    return row[-1]


def lost_passages(spark, r, say, cases):
    """Of (kind, passage, copy), how many of each kind have less than 50 words found; all are similar enough by brute force."""
    rows = []
    for i, (_, p, q) in enumerate(cases):
        assert common_words(p, q) >= chaining.MIN_SHARE * len(q)
        rows += [(i, " ".join(say(50) + p + say(50)), "en", "s", 0), (1000 + i, " ".join(say(60) + q + say(60)), "en", "s", 0)]
    got = defaultdict(int)
    for x in chaining.repeated_passages(spark.createDataFrame(rows, DOCS)).collect():
        i = x.doc_id - 1000
        assert x.owner_id == i and 58 <= x.start and x.end <= 62 + len(cases[i][2])
        got[i] = max(got[i], x.end - x.start)
    lost = defaultdict(int)
    for i, (kind, _, _) in enumerate(cases):
        lost[kind] += got[i] < 50
    return dict(lost)


def test_fuzzy_passages_are_found(spark):
    r = random.Random(31)
    say = lambda k: [f"w{r.randrange(10 ** 9)}" for _ in range(k)]
    cases = []
    for every in (5, 6, 8, 10):
        for n in (55, 75, 100):
            p = say(n)
            cases.append(("regular", p, [say(1)[0] if i % every == every - 1 else w for i, w in enumerate(p)]))
    for n in (50, 60, 100):
        p = say(n)
        cases.append(("regular", p, list(p)))
    for kind, n, rate in (("60 words, 10%", 60, 0.1), ("60 words, 20%", 60, 0.2), ("100 words, 20%", 100, 0.2)):
        for _ in range(40):
            p = say(n)
            q = edited(r, p, say, rate)
            if common_words(p, q) >= chaining.MIN_SHARE * len(q):
                cases.append((kind, p, q))
    lost = lost_passages(spark, r, say, cases)
    assert lost["regular"] == 0 and lost["60 words, 10%"] <= 3 and lost["60 words, 20%"] <= 10 and lost["100 words, 20%"] <= 1


def test_passages_with_shifts_at_their_ends_are_found(spark):
    r = random.Random(32)
    say = lambda k: [f"w{r.randrange(10 ** 9)}" for _ in range(k)]
    cases = []
    for gap in (3, 9):  # the last run of equal words long enough for a seed is far from the end
        for n in (1, 2):
            for side in (1, -1):
                p = say(60)
                q = p[:42] + [w for i in range(42, 60, 3) for w in [*p[i:i + 2], *say(1), p[i + 2]]]
                cases.append(("inserted", p[::side], q[::side]))
            p = say(60)
            q = list(p)
            del q[60 - gap - n:60 - gap], q[gap:gap + n]
            cases.append(("deleted", p, q))
    for _ in range(60):
        p = say(60)
        cases.append(("60 words, 5% + 5%", p, edited(r, p, say, 0.05, 0.05)))
    lost = lost_passages(spark, r, say, cases)
    assert lost.pop("60 words, 5% + 5%") <= 1 and not any(lost.values())


def test_passages_repeated_within_their_first_document(spark):
    r = random.Random(33)
    say = lambda k: [f"w{r.randrange(10 ** 9)}" for _ in range(k)]
    passage, line, apart = say(500), say(20), say(60)
    docs = {1: passage * 20, 2: say(30) + apart + say(90) + apart + say(10), 3: line * 30, 4: say(300), 5: say(15) + passage + say(15)}
    df = spark.createDataFrame([(d, " ".join(w), "en", "s", 0) for d, w in docs.items()], DOCS)
    got = defaultdict(list)
    for x in chaining.repeated_passages(df).collect():
        got[x.doc_id].append((x.start, x.end, x.owner_id))
    assert {d: sorted(v) for d, v in got.items()} == {1: [(500, 10_000, 1)], 2: [(180, 240, 2)], 3: [(20, 600, 3)], 5: [(15, 515, 1)]}
    out = {x.doc_id: words(x.text) for x in chaining.without_passages(df, chaining.repeated_passages(df)).collect()}
    assert out[1] == passage and out[2] == docs[2][:180] + docs[2][240:] and out[3] == line and out[4] == docs[4] and len(out[5]) == 30


def test_different_texts_of_one_id_are_apart(spark):
    import corpus_pipeline

    r = random.Random(34)
    say = lambda k: [f"w{r.randrange(10 ** 9)}" for _ in range(k)]
    p, q = say(80), say(80)
    one, other, long, copy = say(10) + p + say(10), say(70) + q + say(300), say(400), say(30)
    rows = [(1, " ".join(p), "en", "s", 0), (2, " ".join(q), "en", "s", 0)]
    rows += [(5, " ".join(w), "en", "s", 0) for w in (one, other, long, copy, copy)]
    rows += [(6, "x y z", "b", "s", 0), (6, "x y z", "a", "t", 0), (6, "x y z", "b", "a", 0), (6, None, "a", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    found = chaining.repeated_passages(df)
    assert sorted((x.doc_id, x.start, x.end, x.owner_id, x.n_words) for x in found.collect()) == [(5, 10, 90, 1, 100), (5, 70, 150, 2, 450)]
    out = sorted(words(x.text) for x in chaining.without_passages(df, found).filter("doc_id = 5").collect())
    assert out == sorted([one[:10] + one[90:], other[:70] + other[150:], long, copy, copy])
    kept = [tuple(x) for x in corpus_pipeline.one_of_each(spark, df, "").collect()]
    assert sorted(kept, key=str) == sorted({x for x in rows if x[0] < 6} | {rows[-1], rows[-3]}, key=str)
