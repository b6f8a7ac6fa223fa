"""The kernels without Spark, against plain Python."""

import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sqlstrata.llm import chaining, common, mixing, packing, rangecoder, tokens, toxicity, triejoin, warc
from sqlstrata.llm.common import gathered, ngram_hashes, slices, span_hashes, text_buffer, word_spans
from sqlstrata.llm.tokens import Encoder, encoder, public_path

PIECES = ["a", "B", "é", "É", "×", " ", "  ", "\n", "\t", " ", " ", "　", "'s", "'", "!", ".", ",", "1", "23", "ß", "日",
          "́", "é", " ́", "<|endoftext|>", "\x1c", "word", "Σ", "ς", "\x85", "ÿ", "-"]


def random_texts(n, seed, longest=40):
    r = random.Random(seed)
    return [None, "", " ", "\n"] + ["".join(r.choice(PIECES) for _ in range(r.randint(0, longest))) for _ in range(n)]


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def test_word_spans_and_hashes():
    texts = random_texts(600, 3)
    data, off = text_buffer(pa.array(texts, pa.string()))
    s, e, row = word_spans(data, off)
    raw, got = bytes(data), [[] for _ in texts]
    for a, b, r in zip(s, e, row):
        got[r].append(raw[a:b].decode())
    assert got == [words_of(t) for t in texts]
    seen = {}
    for a, b, h in zip(s, e, span_hashes(data, s, e).tolist()):
        assert seen.setdefault(lower(raw[a:b].decode()), h) == h
    assert len(set(seen.values())) == len(seen)


def test_ngrams_stay_in_their_row():
    row = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2])
    h = np.arange(9, dtype=np.uint64)
    g, at = ngram_hashes(h, row, 3)
    assert at.tolist() == [0, 5, 6] and len(set(g.tolist())) == 3


def test_slices_cover_all_rows_in_order():
    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([None, "", "x" * 300] * 16 + ["y" * 5000, "z"])], names=["i", "text"])
    got = [x for s in slices(b, "text", 1000) for x in s.column(0).to_pylist()]
    assert got == list(range(50))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_encoding_equals_whole_texts(name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_path(name))
    whole.encode_special_tokens = True
    enc = Encoder(public_path(name), memory=300)  # generations change often
    for seed in range(4):
        texts = random_texts(400, seed)
        ids, n = enc.encode(*text_buffer(pa.array(texts, pa.string())))
        at = 0
        for t, k in zip(texts, n.tolist()):
            assert ids[at:at + k].tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)
            at += k
        assert at == len(ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_with_latin_letters_and_signs(name):
    """Capital Latin-1 letters, sharp s and signs after a letter give the library's ids."""
    r = random.Random(5)
    letters = "abzABZ\u00c0\u00c8\u00d6\u00d8\u00de\u00df\u00e9\u00f7\u00d7\u00ff"
    signs = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()] + ["=\u0338", "e\u0301", "'s", "'Ll", "\u00a0", " ", "\n", "7"]
    texts = ["".join("".join(r.choice(letters) for _ in range(r.randint(0, 6))) + r.choice(signs) * r.randint(1, 3) for _ in range(40)) for _ in range(200)]
    whole = Encoder(public_path(name)).tok
    ids, n = Encoder(public_path(name)).encode(*text_buffer(pa.array(texts)))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_known_letters_do_not_go_to_the_whole_tokenizer(monkeypatch):
    """Their chunks go to the model at once, which costs a quarter of the time."""
    enc, slow = Encoder(public_path("word_bpe_49k.json")), []

    class Noting:
        def encode_batch(self, rows, **more):
            slow.extend(rows)
            return whole.encode_batch(rows, **more)

    whole, enc.tok = enc.tok, Noting()
    enc.encode(*text_buffer(pa.array(["en\u00dfst \u00c8le \u00c7\u00e9ier atouea$$$ b<c"])))
    assert sorted(slow) == ["$$$", "<c"]


def test_runs_of_letters_are_found_for_all_chunks_at_once():
    r, letter = random.Random(9), "(?:[A-Za-z]|[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])"
    pieces = "azAZ\u00c0\u00d6\u00d7\u00d8\u00df\u00e9\u00f7\u00ff\u0100\u4e2d\u0301 \t19.'@[`{"
    chunks = ["".join(r.choice(pieces) for _ in range(r.randint(1, 4))) for _ in range(4000)]
    chunks += [" " + c for c in chunks] + [" ", "  ", "\u00c3", "\u00c3\u0083", "a\u0083"]
    data, off = text_buffer(pa.array(chunks))
    want = [re.fullmatch(f" ?{letter}+", c) is not None for c in chunks]
    assert tokens._runs(data, off).tolist() == want and 500 < sum(want) < 5000


def test_an_encoder_asks_once_for_all_unknown_chunks(monkeypatch):
    """What kind of chunk it is costs no Python step per chunk: a rule over all bytes tells."""
    asked, runs = [], tokens._runs
    monkeypatch.setattr(tokens, "_runs", lambda data, off: asked.append(len(off) - 1) or runs(data, off))
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}\u00e9" for i in range(600))
    enc = Encoder(public_path("word_bpe_49k.json"))
    ids, _ = enc.encode(*text_buffer(pa.array([text, text])))
    assert asked == [600] and ids.tolist() == 2 * enc.tok.encode(text, add_special_tokens=False).ids


def test_gathered_batches():
    t = pa.table({"doc_id": list(range(50)), "text": ["x" * 100, None] * 25})
    got = list(gathered(iter(t.to_batches(max_chunksize=7)), 1000))
    assert pa.Table.from_batches(got).equals(t.combine_chunks()) or pa.Table.from_batches(got).to_pylist() == t.to_pylist()
    assert 1 < len(got) < 8 and list(gathered(iter([]), 1000)) == []


# ---------------------------------------------------------------- range coder


def test_a_resting_encoder_keeps_recent_chunks_only():
    enc = Encoder(public_path("byte_bpe_50k.json"), memory=5)
    data = np.frombuffer(" ".join(f"word{i} x{i}" for i in range(40)).encode(), np.uint8)
    off = np.array([0, 100, 200, len(data)])
    first = [x.tolist() for x in enc.encode(data, off)]
    enc.encode(data, off)
    assert enc.old
    enc.rest()
    assert not enc.old and enc.new
    assert [x.tolist() for x in enc.encode(data, off)] == first


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 3000])
def test_range_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 49408, n), r.zipf(1.4, n) % 70_000, np.full(n, 7), r.integers(0, 1 << 24, n)):
        ids = ids.astype(np.uint32)
        assert (rangecoder.decode_segment(rangecoder.encode_segment(ids)) == ids).all()


def test_range_coder_compresses_what_it_predicts():
    r = np.random.default_rng(1)
    phrase = r.integers(0, 49408, 50)
    ids = np.concatenate([phrase if r.random() < 0.9 else r.integers(0, 49408, 5) for _ in range(400)]).astype(np.uint32)
    assert len(rangecoder.encode_segment(ids)) < 0.35 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) + 0.6 * len(ids)


def test_range_coder_writes_the_same_blocks_in_32_bit_steps():
    """The blocks are those of the 64-bit steps, byte by byte."""
    ids = np.array([(i * i // 7 + i % 11 * (i // 300)) % 4001 if i % 5 else i % 97 for i in range(30_000)], np.uint32)
    ids[123] = (1 << 24) - 1
    blob = rangecoder.encode_segment(ids)
    assert (len(blob), zlib.crc32(blob)) == (46573, 3114292422)
    assert rangecoder.decode_segment(blob).tolist() == ids.tolist()
    m = rangecoder._Model(8)
    a, f2, f1 = m.predict()
    x = np.full(8, 5, np.int32)
    m.update(x, a == x)
    assert {v.itemsize for v in (a, f2, f1, m.z, m.z2, m.k, m.p, m.v)} == {4}


def test_range_coder_resolves_order_0_exactly_in_doubles():
    """Its quotients stay below the next whole number at the widest range."""
    r = random.Random(2)
    for bits in (18, 22, 26):
        part = [(1 << 48 - bits), (1 << 48 - bits) - 1, *(r.randrange(1, 1 << 48 - bits) for _ in range(500))]
        place = [r.randrange(1 << bits) for _ in part[1:]] + [(1 << bits) - 1]
        code = np.array([p * k + p - 1 for p, k in zip(part, place)])
        assert (code / np.array(part)).astype(np.int64).tolist() == place


def test_range_coder_blocks_are_checked_and_independent():
    ids = (np.random.default_rng(2).zipf(1.3, 5000) % 5000).astype(np.uint32)
    blob = rangecoder.encode_segment(ids, block=500)
    for at in (0, 30, len(blob) // 2, len(blob) - 3):
        bad = bytearray(blob)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            rangecoder.decode_segment(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.decode_segment(blob[:-7])


# ---------------------------------------------------------------- packing, mixing


def test_packing_fills_sequences_without_padding():
    r = random.Random(2)
    for _ in range(200):
        cap = r.choice([8, 16, 64])
        docs = [r.randint(1, 5 * cap) for _ in range(r.randint(0, 60))]
        seqs, parts = {}, {}
        for d, start, n, q, off in packing.assign(np.array(docs), cap, 1 / cap):
            seqs.setdefault(q, []).append((off, n))
            parts.setdefault(d, []).append((start, n))
        for v in seqs.values():
            at = 0
            for off, n in sorted(v):
                assert off == at and n > 0
                at += n
            assert at == cap or (at < cap and at & (at - 1) == 0)
        for d, n in enumerate(docs):
            at = 0
            for start, k in sorted(parts[d]):
                assert start == at
                at += k
            assert at == n
        assert sum(sum(k for _, k in v) != cap for v in seqs.values()) <= cap.bit_length()


def test_packing_takes_the_cheapest_sequence_that_fits():
    # full sequences hold 10; the pieces of 6 take one each, then 4 and 4 fill them
    got = packing.assign(np.array([6, 4, 6, 4]), 10, 0.1)
    assert {q for d, _, _, q, _ in got if d in (0, 2)} == {0, 1} and all(n in (6, 4) for _, _, n, _, _ in got)


def test_fit_counts_reaches_the_best_sum():
    r = random.Random(5)
    for _ in range(200):
        k = r.randint(1, 5)
        length = np.array(r.sample(range(1, 30), k))
        count = np.array([r.randint(1, 4) for _ in range(k)])
        budget = r.randint(0, int((length * count).sum()) + 2)
        take = mixing.fit_counts(length, count, budget)
        assert (take >= 0).all() and (take <= count).all() and (take * length).sum() <= budget
        # best completion of the equal share, by brute force
        whole = int((length * count).sum())
        base = np.array([int(c) * min(budget, whole) // whole for c in count])
        sums = {0}
        for l, left in zip(length.tolist(), (count - base).tolist()):
            sums = {s + l * j for s in sums for j in range(left + 1)}
        rest = min(budget, whole) - int((base * length).sum())
        assert (take * length).sum() == int((base * length).sum()) + max(s for s in sums if s <= rest)


# ---------------------------------------------------------------- archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    caps = [("http://a/ b\n", "20200101000000", warc.http_block(b"x\r\n\r\ny")), (None, "20200101000000", warc.http_block(b"")),
            ("http://é", "19991231235959", b"plain\nx")]
    got = list(warc.parse_arc(warc.build_arc(caps, version)))
    assert [c["block"] for c in got] == [c[2] for c in caps]
    assert [c["URL"] for c in got] == ["http://a/%20b%0A", "-", "http://é"]


def test_arc_damage_is_an_error():
    good = warc.build_arc([("http://a/", "20200101000000", b"abc")], 1)
    for bad in (good[:-3], good.replace(b"1 0 sqlstrata", b"3 0 sqlstrata"), good[good.index(b"http://a/"):],
                good.replace(b"text/html 3", b"text/html x 3")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


def test_warc_record_ids_and_records():
    d = warc.digest(b"z")
    for key in (0, 5, -7, 2 ** 63 - 1, None):
        assert warc.key_of(warc.record_id(key, d)) == key
    cap = {"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "20200102030405", "Content-type": "text/html",
           "block": warc.http_block("é\r\n\r\nWARC/1.1".encode())}
    text = warc.warc_record(4, cap, None) + "\r\n\r\n" + warc.warc_record(3, cap, 4) + "\r\n\r\n"
    (f1, b1), (f2, b2) = warc.parse_warc(text.encode())
    assert b1 == cap["block"] and f1["warc-type"] == "response" and f1["warc-date"] == "2020-01-02T03:04:05Z"
    assert f2["warc-type"] == "revisit" and f2["warc-refers-to"] == f1["warc-record-id"] and b2.endswith(b"\r\n\r\n")
    assert f1["warc-payload-digest"] == f2["warc-payload-digest"]
    with pytest.raises(ValueError):
        list(warc.parse_warc(text.encode()[:-9]))


# ---------------------------------------------------------------- sentences


def test_sentences():
    texts = ["One two. Three!\nFour", None, "", "...", "no end é", "a.b"]
    data, off = text_buffer(pa.array(texts, pa.string()))
    s, e, sent, row = toxicity.sentences(data, off)
    raw, got = bytes(data), {}
    for a, b, k in zip(s, e, sent):
        got.setdefault(int(k), []).append(raw[a:b].decode())
    assert [(int(row[k]), v) for k, v in got.items()] == [
        (0, ["One", "two"]), (0, ["Three"]), (0, ["Four"]), (4, ["no", "end", "é"]), (5, ["a"]), (5, ["b"])]


def test_noisy_or_learns_the_offending_word():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        sents = [" ".join(r.choice(vocab) for _ in range(8)) for _ in range(r.randint(1, 6))]
        y = i % 4 == 0
        if y:
            sents[r.randrange(len(sents))] += " grubble" + r.choice(["", "s", "d"])
        texts.append(". ".join(sents))
        labels.append(int(y))
    data, off = text_buffer(pa.array(texts))
    s, e, sent, row = toxicity.sentences(data, off)
    f, of = toxicity.pairs(data, s, e, sent)
    used, f = np.unique(f, return_inverse=True)
    model = toxicity.fit(used, f, of, row, np.array(labels))
    b = pa.RecordBatch.from_arrays([pa.array(["all w1 w2. you grubblez w3", "w5 w6. w7", ""])], names=["text"])
    total, rows, _, _, p = toxicity._score_slice(b, 0, model.weights, model.bias)
    assert total[0] > 0.7 and total[1] < 0.3 and total[2] == 0
    assert p[rows == 0].argmax() == 1


# ---------------------------------------------------------------- trees and chains


def test_prefix_tree_finds_all_links():
    r = random.Random(4)
    for _ in range(100):
        base = r.sample(range(1000), 60)
        sets = []
        for _ in range(r.randint(1, 25)):
            x = set(base[:r.randint(1, 60)])
            for _ in range(r.randint(0, 12)):
                x.add(r.randrange(1000))
            sets.append(np.array(sorted(x), np.uint64))
        probe = set(base)
        want = [i for i, s in enumerate(sets) if 100 * len(probe & set(s.tolist())) >= 80 * len(probe | set(s.tolist()))]
        got = triejoin.PrefixTree(sets).links(np.array(sorted(probe), np.uint64), 80)
        assert sorted(got) == want


def test_blocks_meet_over_trees(monkeypatch):
    """Every pair comes once with its common prefix shingles; links are never
    among those that a subtree's bounds leave out, which are some."""
    r = random.Random(3)
    sharing = given = 0
    for _ in range(120):
        monkeypatch.setattr(triejoin, "WALK_PAIRS", r.choice([4, 50, 1 << 19]))
        rows, whole, tiles = [], [], r.randint(1, 3)
        for tile in range(tiles):
            base = sorted(r.sample(range(300), r.randint(3, 60)))
            for _ in range(r.randint(1, 14)):
                x = sorted({b for b in base if r.random() < r.choice([.8, .9, .97])} | {r.randrange(300) for _ in range(r.randint(1, 5))})
                head, probe = x[:int(triejoin.prefix_size(np.array([len(x)]))[0])], r.random() < .5
                away = r.choice([0, 0, 1, 9])
                rows += [(tile, len(whole), 0, len(x), 0, len(head) + away, k, probe) for k in head]
                whole.append((tile, probe, set(x), set(head)))
        cols, probe = np.array([q[:7] for q in rows], np.int64), np.array([q[7] for q in rows])
        probes, sets = (triejoin.Sets(*cols[side].T) for side in (probe, ~probe))
        got = [(int(probes.doc[i]), int(sets.doc[j]), int(k)) for p, y, c in triejoin.tree_pairs(probes, sets, tiles) for i, j, k in zip(p, y, c)]
        common = {(i, j): len(a[3] & b[3]) for i, a in enumerate(whole) for j, b in enumerate(whole) if a[0] == b[0] and a[1] and not b[1]}
        assert len({g[:2] for g in got}) == len(got) and all(common[i, j] == k for i, j, k in got)
        links = {(i, j) for i, j in common if 5 * len(whole[i][2] & whole[j][2]) >= 4 * len(whole[i][2] | whole[j][2])}
        assert links <= {g[:2] for g in got}
        sharing, given = sharing + sum(k > 0 for k in common.values()), given + len(got)
    assert given < 0.9 * sharing


def test_shingle_sets():
    texts = ["a b C d e f", "A b c d e", "x y", "X  y", "", None, "  ", "q q q q q q q"]
    g, row = triejoin.shingle_sets(*text_buffer(pa.array(texts, pa.string())))
    per = [set(g[row == i].tolist()) for i in range(len(texts))]
    assert [len(p) for p in per] == [2, 1, 1, 1, 0, 0, 0, 1]
    assert per[1] < per[0] and per[2] == per[3]


def test_fenwick_prefix_maxima():
    r = random.Random(7)
    n = 30
    tree, plain = chaining.Fenwick(n), {}
    for i in range(300):
        if r.random() < 0.5:
            k, v = r.randint(1, n), r.uniform(-5, 5)
            tree.put(k, v, i)
            plain.setdefault(k, []).append(v)
        q = r.randint(0, n)
        want = max((v for k, vs in plain.items() if k <= q for v in vs), default=float("-inf"))
        assert tree.top(q)[0] == want


def test_chain_score_equals_quadratic_programme():
    r = random.Random(9)
    for _ in range(100):
        n = r.randint(1, 14)
        x = np.array(sorted(r.sample(range(60), n)))
        y = np.array([r.randrange(60) for _ in range(n)])
        got = chaining.chains(x, y, max_gap=10 ** 6)
        assert sorted(i for c in got for i in c.tolist()) == list(range(n))
        for c in got:
            assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all()
        score = []
        for i in range(n):
            best = 0.0
            for j in range(i):
                if x[j] < x[i] and y[j] < y[i]:
                    best = max(best, score[j] - chaining.GAP * (x[i] - x[j] + y[i] - y[j]) + min(8, x[i] - x[j], y[i] - y[j]) - 8)
            score.append(8 + best)

        def value(c):
            v = 8.0
            for a, b in zip(c, c[1:]):
                v += min(8, x[b] - x[a], y[b] - y[a]) - chaining.GAP * (x[b] - x[a] + y[b] - y[a])
            return v
        assert max(value(c) for c in got) <= max(score) + 1e-9


def test_seeds_are_shared_by_shared_words():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([r.integers(0, 1 << 62, 40).astype(np.uint64), a[100:130], r.integers(0, 1 << 62, 40).astype(np.uint64)])
    ga, _ = chaining.seeds(a, np.zeros(300, np.int64))
    gb, _ = chaining.seeds(b, np.zeros(110, np.int64))
    assert set(ga.tolist()) & set(gb.tolist())
    for i in range(0, 280, 15):  # every 2k - 1 words hold a seed
        assert len(chaining.seeds(a[i:i + 15], np.zeros(15, np.int64))[0])


def test_align_bridges_changes():
    a = np.arange(100, 200).astype(np.uint64)
    b = np.concatenate([np.arange(5), np.arange(100, 130), [7, 7], np.arange(131, 160), np.arange(165, 200), np.arange(9)]).astype(np.uint64)
    ys = np.array([5, 47, 80])
    xs = (b[ys] - 100).astype(np.int64)
    s, e, os_, oe, same = chaining.align(a, b, xs, ys)
    assert (s, e, os_, oe) == (0, 100, 5, 101) and same == 94


def test_ids_crc_is_of_little_endian_words():
    ids = np.array([1, 70_000], "<u4")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(struct.pack("<2I", 1, 70_000))


def test_ends_are_aligned_over_gaps():
    r = random.Random(4)
    for _ in range(150):
        a = [r.randrange(6) for _ in range(r.randint(0, 14))]
        b = [r.randrange(6) for _ in range(r.randint(0, 14))]
        common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                common[i + 1][j + 1] = max(common[i][j] + (x == y), common[i][j + 1], common[i + 1][j])
        best = max(common[i][j] - chaining.MIN_SHARE / 2 * (i + j) for i in range(len(a) + 1) for j in range(len(b) + 1))
        i, j, n = chaining._extend([(np.array(a, np.uint64), np.array(b, np.uint64)), (np.arange(20), np.arange(20))])[0].tolist()
        assert n == common[i][j] and abs(n - chaining.MIN_SHARE / 2 * (i + j) - best) < 1e-6


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_of_the_queries_equals_the_unchanged_library(name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_path(name))
    assert not whole.encode_special_tokens
    r = random.Random(8)
    literals = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<|", "<|endo", "ftext|>"]
    texts = ["the end <|endoftext|> next", None, "", "<|endoftext|>", " <|endoftext|><|endoftext|> ", "<|endo", "ftext|> in two rows",
             "no literal", "É<|startoftext|>é"]
    texts += random_texts(300, 17) + ["".join(r.choice(PIECES + literals * 2) for _ in range(r.randint(0, 30))) for _ in range(600)]
    for part in (texts, texts[5:8], texts[:1], texts[1:3], [t for t in texts if t and "<|endoftext|>" in t]):
        ids, n = encoder(public_path(name)).encode(*text_buffer(pa.array(part, pa.string())))
        assert len(n) == len(part) and n.sum() == len(ids)
        for t, x in zip(part, np.split(ids, np.cumsum(n)[:-1])):
            assert x.tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_packed_columns_come_back():
    r = np.random.default_rng(5)
    cols = [np.zeros(0, np.uint64), np.zeros(3, np.uint64), r.integers(0, 256, 1000).astype(np.uint64),
            r.integers(0, 1 << 40, 777).astype(np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64)]
    back = common.unpack_columns(common.pack_columns(*cols))
    assert len(back) == len(cols) and all((a == b).all() and len(a) == len(b) for a, b in zip(cols, back))
    n = np.array([1, 3, 2])
    x = np.array([9, 4, 5, 90, 0, 7])
    assert (chaining._sums(chaining._rises(x, np.cumsum(n) - n), n) == x).all()


def test_pairs_that_are_not_chained_have_no_chain():
    r = np.random.default_rng(6)
    for _ in range(300):
        key = np.sort(r.integers(0, 4, 12))
        x = np.sort(r.choice(400, 12, replace=False))
        x = np.concatenate([np.sort(x[key == k]) for k in range(4)])
        y = r.integers(0, 200, 12) if r.random() < 0.5 else x + r.integers(0, 3, 12)
        kept = {int(key[a]) for a, _ in chaining._hopeful(key, key, x, y)}
        for k in set(key.tolist()) - kept:
            at = key == k
            assert all(chaining.matched_words(x[at][c]) < chaining.MIN_CHAIN for c in chaining.chains(x[at], y[at]))
