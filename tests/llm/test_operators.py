"""The text operators against brute force, on small tables with nulls, empty texts, ties and clashing columns."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from segmenta.llm import byte_bpe, fingerprints, grammar_shards, license_scan, near_dedup, packing, passage_dedup, quality_rules, shards, warc

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LETTERS = "aeioustrnl"


def sentence(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(30, 300)) for _ in range(30)]
    passage = sentence(rng, 60)
    out = [*base, None, "", "one two", base[0], base[0]]
    out += [base[1].replace(base[1].split()[5], "zzz", 1), base[2][:40] + " " + passage + " " + base[2][40:], base[3] + " " + passage + " tail words here"]
    out += ["Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3. CC BY cc by", "ab " * 50, "é ß ЖЯ 漢字 don't I'll 12 3 <tag> # $", "x" * 5000]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, digest long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def test_token_shards_round_trip(docs, texts, empty):
    root, manifest = grammar_shards.write_shards(docs, WORD, shard_ids=500)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in grammar_shards.read_shards(root, manifest).collect())
    lib, at = Tokenizer.from_file(WORD), 0
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert manifest.count() > 1
    assert grammar_shards.read_shards(*grammar_shards.write_shards(empty, WORD)).count() == 0


def test_grammar_random_access():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 50, 6).astype("<u4") for _ in range(20)]
    ids = np.concatenate([words[k] for k in rng.integers(0, 20, 20_000)])
    shard = grammar_shards.Shard(grammar_shards.pack_shard([7], [ids.tobytes()]))
    assert len(shard.rules) and shard.expansions.max() > 2
    assert all((shard.ids(a, b) == ids[a:b]).all() for a, b in [(0, 5), (777, 1234), (0, len(ids)), (len(ids) - 1, len(ids))])


def test_byte_bpe_matches_library(docs, texts):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE), special_tokens={})
    for r in byte_bpe.encode_documents(docs, BYTE, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids) and bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_packing_is_gapless(docs, texts, empty):
    rows = packing.pack(docs, WORD, size=64).collect()
    lib, per, fill = Tokenizer.from_file(WORD), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(per[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), 64))
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in pieces)
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty, WORD).count() == 0


def test_bitmap_filter_never_loses_a_similar_pair():
    rng = np.random.default_rng(3)
    sketch = rng.poisson(2, 1 << near_dedup.SKETCH_BITS).astype(np.float64) * rng.choice([1, 40, 4000], 1 << near_dedup.SKETCH_BITS)
    weights = near_dedup.Weights(sketch, 5000)
    kept = similar = 0
    for _ in range(3000):
        base = rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)
        changed = rng.random(len(base)) < rng.choice([0.0, 0.02, 0.05, 0.1, 0.2])
        other = np.where(changed, rng.choice(base, len(base)), base) if rng.random() < 0.5 else np.where(changed, base ^ np.uint64(1), base)
        one, two = weights.of(base), weights.of(other)
        maps = [near_dedup.bitmap(*x, weights) for x in (one, two)]
        may = bool(near_dedup.may_be_similar(maps[0], maps[1][None], float(one[1].sum(dtype=np.float64)), np.array([two[1].sum(dtype=np.float64)]))[0])
        is_similar = near_dedup.similar(one, two, weights)
        assert may or not is_similar
        kept, similar = kept + may, similar + is_similar
    assert 500 < similar <= kept < 2700


def test_similar_texts_with_few_equal_samples_are_compared(spark):
    """Texts alike by tf alone, whose rare differences leave few of their weighted samples equal."""
    rng = random.Random(9)
    hashes = lambda x: near_dedup.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0]
    for _ in range(20_000):
        shared = sentence(rng, 85)
        pair = [f"{shared} {sentence(rng, 10)}" for _ in range(2)]
        sketch = np.zeros(1 << near_dedup.SKETCH_BITS)
        sketch[(near_dedup.shingles(hashes(shared)) >> np.uint64(64 - near_dedup.SKETCH_BITS)).astype(np.int64)] = 4900
        weights = near_dedup.Weights(sketch, 5000)
        sets = [weights.of(hashes(x)) for x in pair]
        drawn = [near_dedup.samples(*x) for x in sets]
        low = [(x & np.uint64(255)).astype(np.uint8) for x in drawn]
        if (low[0] == low[1]).sum() < 52 and near_dedup.similar(*sets, weights):
            break
    texts = spark.createDataFrame([(d, x, bytes(s)) for d, x, s in zip("pq", pair, low, strict=True)], "digest string, text string, short binary")
    members = spark.createDataFrame([(1, "p"), (1, "q")], "key long, digest string")
    links = spark.createDataFrame([], "a string, b string")
    got = near_dedup._across(members, links, texts, spark.sparkContext.broadcast(weights)).distinct().collect()
    assert [(r.a, r.b) for r in got] == [("q", "p")]


def test_near_classes_match_brute_force(docs, texts, empty):
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    sets = [{tuple((t or "").split()[k : k + 5]) for k in range(len((t or "").split()) - 4)} or {(t or "",)} for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in range(len(texts))}
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))
    assert near_dedup.near_classes(empty).count() == 0


def test_passages_match_brute_force(docs, texts, empty):
    rows = passage_dedup.repeats(docs).collect()
    windows = collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k in range(len(w) - 49):
            windows[tuple(w[k : k + 50])].add(i)
    want = set().union(*[s for s in windows.values() if len(s) > 1])
    assert want <= {r.doc_id for r in rows} and all(r.n_words >= 50 for r in rows)
    out = {r.doc_id: r for r in passage_dedup.without_repeats(docs).collect()}
    assert len(out) == len(texts) and all(out[i].text == texts[i] for i in range(len(texts)) if i not in {r.doc_id for r in rows if r.removed})
    assert all(r.n_chars == len(r.text or "") for r in out.values())
    assert passage_dedup.repeats(empty).count() == 0


def test_passages_with_a_frequent_paragraph(spark):
    """F < A < X < B all have the only paragraph of a passage that A and B alone share."""
    def hashes(x):
        return passage_dedup.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0]

    for seed in range(1000):
        rng = random.Random(seed)
        passage = sentence(rng, 50).split()
        place = int(passage_dedup.units(hashes(" ".join(passage)))[0][0])
        around = lambda middle: " ".join([sentence(rng, 60), *middle, sentence(rng, 60)])
        rows = [(k, around(passage if k % 2 else passage[place : place + 20])) for k in range(4)]
        if all({x - 60 for x in passage_dedup.units(hashes(rows[k][1]))[0].tolist() if 60 <= x <= 90} == {place} for k in (1, 3)):
            break
    got = {(r.doc_id, r.removed) for r in passage_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()}
    assert got == {(1, False), (3, True)}


def test_passage_matches_keep_long_stretches():
    """A line of the repeat that the other text has twice doesn't break the repeat up."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 60, 2000).astype(np.uint64)
    a, b = np.concatenate([words[:30], words[100:170], words[1900:]]), words.copy()
    b[1000:1024] = b[123:147]
    assert passage_dedup.matches(a, b, [(53, 123, True), (53, 1000, True)]) == [(30, 100, 100, 170)]
    a[60] ^= np.uint64(1)  # of one wrong word, two stretches are still one repeat
    assert passage_dedup.matches(a, b, [(33, 103, True), (65, 135, True)]) == [(30, 100, 100, 170)]
    # The same words twice in the other text are two repeats.
    b[1500:1570] = words[100:170]
    assert [x[2] for x in passage_dedup.matches(a, b, [(33, 103, True), (65, 135, True), (33, 1503, True), (65, 1535, True)])] == [100, 1500]


def test_passages_go_only_where_a_copy_stays(spark):
    """A popular passage within a longer repeat, and a staggered overlap: every word stays somewhere, in one document."""
    rng = random.Random(8)
    p, left, right, s = sentence(rng, 60), sentence(rng, 220), sentence(rng, 220), sentence(rng, 120).split()
    rows = [(0, sentence(rng, 40) + " " + p), (1, f"{left} {p} {right}"), (2, f"{left} {p} {right}")]
    rows += [(10, " ".join(s[:60]) + " " + sentence(rng, 30)), (11, " ".join(s)), (12, sentence(rng, 30) + " " + " ".join(s[55:]))]
    out = {r.doc_id: r.text.split() for r in passage_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1].split() and out[1] == f"{left} {right}".split() and out[2] == []
    assert out[10] == rows[3][1].split() and out[11] == s[60:] and out[12] == rows[5][1].split()[:30]
    assert passage_dedup.cut_words("a b c d e f", [(0, 5), (1, 2), (4, 5)]) == " f"


def test_quality_statistics(docs, texts):
    for r in quality_rules.statistics(docs).collect():
        t = texts[r.doc_id] or ""
        w = [x for x in __import__("re").split("[ \t-\r]+", t) if x]
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_decision_list_finds_planted_rule():
    rng = random.Random(2)
    rows = [({"a": rng.random(), "b": rng.random()}, False) for _ in range(600)]
    rows = [(x, x["a"] > 0.8 and x["b"] < 0.5) for x, _ in rows]
    rules = quality_rules.learn(rows)
    said = [any(all(t.holds(x) for t in r) for r in rules) for x, _ in rows]
    assert sum(a == b for a, (_, b) in zip(said, rows, strict=True)) > 0.97 * len(rows)
    assert quality_rules.learn([]) == []


def test_quality_without_labels(spark, docs):
    out = quality_rules.judged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.filter("kept = base_failed").count() == 0 and out.count() == docs.count()


def test_licenses(docs, texts):
    import re

    for r in license_scan.scanned(docs).collect():
        t = "".join(c.lower() if c.isascii() else c for c in texts[r.doc_id] or "")
        w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", t) if x]
        hits = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_fingerprints(docs, texts, empty):
    rows = {r.doc_id: r for r in fingerprints.compared_with_next(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[0].fingerprint == rows[33].fingerprint == rows[34].fingerprint
    assert rows[34].near_next == 1.0
    assert fingerprints.compared_with_next(empty).count() == 0


def test_warc_round_trip_and_salvage(spark):
    pages = spark.createDataFrame([(3, "http://a", "x"), (1, "http://b\r\n", "x"), (2, None, None), (5, "u", ""), (9, "v", "é" * 70_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archived_pages(pages).collect()}
    assert (got[1].record_type, got[3].record_type, got[3].refers_to) == ("response", "revisit", 1)
    assert (got[2].record_type, got[5].refers_to, got[9].payload_bytes) == ("response", 2, 140_000)
    assert got[3].payload_bytes == 1 and got[3].payload_digest == warc.digest(b"x")
    parts = [warc.member(warc.record(k, "u", b"payload %d" % k * 20)) for k in range(9)]
    data = bytearray(b"".join(parts))
    at = np.append(0, np.cumsum([len(x) for x in parts]))
    data[at[4] + 40] ^= 255
    found = list(warc.salvage(bytes(data)))
    assert sum(x is not None for *_, x in found) == 8 and [(a, b) for a, b, x in found if x is None] == [(at[4], at[5])]
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_warc_salvage_within_a_member():
    rng = random.Random(6)
    records = [warc.record(k, "u", sentence(rng, 9000).encode()) for k in range(9)]
    good = warc.member(warc.record(9, "u", b"after"))
    ids = lambda data: [x["id"] for *_, x in warc.salvage(data) if x]
    want = lambda *some: [f"<urn:page:{k}>" for k in some]
    gaps = lambda data: [(a, b) for a, b, x in warc.salvage(data) if x is None]
    # The first record's digest fails in a member that is whole.
    one = warc.member(b"".join([records[0].replace(b"sha1:", b"sha1:X"), *records[1:]]))
    assert ids(one + good) == want(*range(1, 10)) and gaps(one + good) == [(0, len(one))]
    # A wrong checksum, a deflate error and a missing end keep what inflated before them.
    one = bytearray(warc.member(b"".join(records)))
    one[-8] ^= 255
    assert ids(bytes(one) + good) == want(*range(10)) and gaps(bytes(one) + good) == [(0, len(one))]
    for cut in (one[: len(one) // 2], one[: len(one) // 2] + b"\xff" * 400):
        got = ids(good + bytes(cut) + good)
        assert got[0] == got[-1] == "<urn:page:9>" and got[1:-1] == want(*range(len(got) - 2)) and len(got) >= 5
        assert gaps(good + bytes(cut) + good) == [(len(good), len(good) + len(cut))]


def test_tiered_store(docs, empty):
    store, version = shards.compacted(docs, arrivals=9, base_bytes=1 << 30)
    assert store.read().drop("shard").exceptAll(docs).count() == 0 and store.read().count() == docs.count()
    assert len(store.manifest()["runs"]) < 9 and version == store.versions()[-1]
    with pytest.raises(RuntimeError):
        store.commit({"version": version - 1, "runs": []}, [])
    empty_store, _ = shards.compacted(empty)
    assert empty_store.read().count() == 0
