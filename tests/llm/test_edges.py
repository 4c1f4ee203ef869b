"""Nulls, repeated rows, ids with several texts, negative ids, long texts, clashing columns and empty tables, for every operator."""

import collections
import random
import struct
import time
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from segmenta.llm import byte_bpe, fingerprints, grammar_shards, license_scan, near_dedup, packing, passage_dedup, quality_rules, shards, warc
from segmenta.llm.encoding import WordEncoder
from segmenta.llm.store import write_new
from tests.llm.test_operators import sentence

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
#: Names that results and inner columns have as well.
CLASHING = "kept n_words rule arrival shard cuts digest key row piece label bands comp length part place units cluster_id input_kept _row _text _digest".split()


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(11)
    long = sentence(rng, 20_000)
    a, b = sentence(rng, 120), sentence(rng, 90)
    out = [(-9, a), (-5, a), (3, a + " tail"), (7, b), (7, sentence(rng, 200)), (7, b), (8, None), (9, ""), (None, a), (None, None), (10, "one two"), (11, long), (12, long), (13, "x " * 4000), (14, b + " " + sentence(rng, 60))]
    return out


@pytest.fixture(scope="session")
def edges(spark, rows):
    table = [(i, t, "en", "s", -1 if t is None else len(t), *[k] * len(CLASHING)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(7, 1, 0), (10, 0, 0), (None, 0, None), (8, None, None)], "doc_id long, quality int, toxic int")


def test_shards_keep_every_row(edges, rows):
    got = grammar_shards.read_shards(*grammar_shards.write_shards(edges, WORD, shard_ids=5000)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    lib = Tokenizer.from_file(WORD)
    want = collections.Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


def test_grammar_goes_on_until_no_pair_is_frequent():
    import numpy as np

    rng = np.random.default_rng(2)
    passage = rng.integers(0, 40_000, 300)
    ids = np.concatenate([np.concatenate([passage, rng.integers(0, 40_000, 20)]) for _ in range(64)] + [np.zeros(1000, int), rng.integers(0, 30, 20_000)]).astype("<u4")
    symbols, rules, base = grammar_shards.compress(ids)
    pairs = collections.Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True))
    overlapping = {p for p in pairs if p[0] == p[1]}
    assert max(n for p, n in pairs.items() if p not in overlapping) < grammar_shards.LEAST
    lengths = grammar_shards.expansion_lengths(rules, base)
    assert lengths.max() >= 300 and (grammar_shards.expand(symbols, rules, base) == ids).all()
    assert all(lengths[k] == len(grammar_shards.expand(np.array([base + k], np.uint32), rules, base)) for k in range(0, len(rules), 50))
    shard = grammar_shards.Shard(grammar_shards.pack_shard([1], [ids.tobytes()]))
    places = rng.integers(0, len(ids), (200, 2))
    assert all((shard.ids(min(p), max(p)) == ids[min(p) : max(p)]).all() for p in places.tolist())


def test_encoder_matches_the_library():
    rng = random.Random(1)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ABCXYZ", "0123456789", "'' ' '", "éßÀÖØøÿü÷×", " \t\n\r\x0b\x0c", "!?.,;:#$%&*()[]<|>_-", "\xa0\x85 İKſﬁ漢字жЯ́é", "\x00\x1c\x7f"]
    encoder = WordEncoder(WORD, limit=2000)
    for k in range(20_000):
        t = "".join(rng.choice(rng.choices(letters, [8, 2, 2, 2, 2, 3, 2, 0.3 if k % 2 else 0, 0.05])[0]) for _ in range(rng.randint(0, 60)))
        t = t.replace("x", "'ll").replace("y", "'s ").replace("q", " 're") if k % 3 == 0 else t
        ids = encoder.library.encode(t, add_special_tokens=False).ids
        assert encoder.encode([t]) == [struct.pack(f"<{len(ids)}I", *ids)], t


def test_near_classes_of_edges(edges, rows):
    got = near_dedup.near_classes(edges).collect()
    assert len(got) == len(rows)
    of = collections.defaultdict(list)
    for r in got:
        of[r.class_id, r.class_digest].append(r)
    assert all(sum(r.keeper for r in c) == 1 for c in of.values())
    by_id = {(r.doc_id, r.digest): r for r in got}
    assert {r.class_id for (i, _), r in by_id.items() if i in (-9, -5, 3)} == {-9} and {r.class_id for (i, _), r in by_id.items() if i in (11, 12)} == {11}
    assert len({r.class_digest for (i, _), r in by_id.items() if i == 7}) == 2
    kept = near_dedup.deduplicated(edges)
    assert kept.columns == edges.columns and kept.count() == len(of)
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in edges.collect()}


def test_quality_of_edges(edges, rows, labels):
    judged = quality_rules.judged(edges, labels)
    assert judged.count() == len(rows) and {"input_kept", "input_n_words", "input_rule", "arrival"} <= set(judged.columns)
    first = judged.filter("doc_id = 10").first()
    assert first.n_words == 2 and first.base_failed and not first.kept and first.input_n_words == rows.index((10, "one two"))
    kept = quality_rules.accepted(edges, labels)
    assert kept.columns == edges.columns
    bad = lambda t: len((t or "").split()) < 10 or t.startswith("x x")
    assert collections.Counter(tuple(r) for r in kept.collect()) == collections.Counter(tuple(r) for r in edges.collect() if not bad(r.text))
    assert quality_rules.accepted(edges.limit(0), labels).count() == 0


def test_packing_uses_as_few_sequences_as_best_fit(edges, rows):
    for size in (64, 300, 2048):
        got = packing.pack(edges, WORD, size=size).collect()
        lengths = sorted((r.length for r in got if r.length < size), reverse=True)
        room: list[int] = []
        for n in lengths:
            fits = [x for x in room if x >= n]
            if fits:
                best = min(fits)
                room.remove(best)
                room.append(best - n)
            else:
                room.append(size - n)
        assert len({r.sequence_id for r in got}) == len(room) + sum(r.length == size for r in got)
        assert collections.Counter(r.doc_id for r in got if r.piece == 0) == collections.Counter(i for i, _ in rows)
        fill = collections.defaultdict(list)
        for r in got:
            fill[r.sequence_id].append((r.offset, r.length))
        assert all(o == sum(n for _, n in sorted(s)[:k]) for s in fill.values() for k, (o, _) in enumerate(sorted(s)))


def test_histogram_plan_equals_best_fit():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.randint(2, 60)
        histogram = {n: rng.randint(0, 30) for n in range(1, size)}
        room: list[int] = []
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            fits = [x for x in room if x >= n]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else size) - n)
        assert packing.plan(histogram, size)[1] == len(room)


def test_fingerprints_of_edges(edges, rows):
    got = fingerprints.compared_with_next(edges).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (11, 12)}) == 1


def slow_digest(text: bytes, ranks) -> list:
    """The features of a text window by window, as filters of bits."""
    import math

    n, size, none = len(text), fingerprints.WINDOW, 1 << 60
    if n < size:
        chosen = [text] if n else []
    else:
        rank = []
        for k in range(n - size + 1):
            counts = collections.Counter(text[k : k + size])
            bits = sum(round(c * math.log2(c) * (1 << 20)) for c in counts.values())
            r = int(ranks[min(1000, max(0, ((6 * size << 20) - bits) * 1000 // (6 * size << 20)))])
            rank.append((r, k) if r >= 0 else None)
        votes = collections.Counter()
        for k in range(-size + 1, len(rank)):
            near = [rank[j] for j in range(max(0, k), min(len(rank), k + size)) if rank[j]]
            if near:
                votes[min(near)[1]] += 1
        chosen = [text[k : k + size] for k in sorted(votes) if votes[k] >= fingerprints.VOTES]
    multiplier, mask, out, seen = 0x9E3779B97F4A7C15, (1 << 64) - 1, [], set()
    for w in chosen:
        h = sum((b + 1) * pow(multiplier, j, 1 << 64) for j, b in enumerate(w)) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = ((h ^ (h >> shift)) * factor) & mask
        if h not in seen:
            if len(seen) % fingerprints.PER_FILTER == 0:
                out.append(set())
            seen.add(h)
            out[-1] |= {(h >> (11 * k)) & (fingerprints.BITS - 1) for k in range(5)}
    return out


def test_digests_match_the_slow_version():
    import numpy as np

    rng = random.Random(5)
    texts = [sentence(rng, n).encode() for n in (0, 3, 12, 40, 300, 900)] + [b"ab" * 200, "é漢字 ".encode() * 60]
    histogram = np.zeros(1001, np.int64)
    for t in texts:
        e = fingerprints.entropies(np.frombuffer(t, np.uint8))
        histogram += np.bincount(e, minlength=1001)
    ranks = fingerprints.ranks_by_rarity(histogram)
    found = fingerprints.digests(texts, ranks)
    slow = [slow_digest(t, ranks) for t in texts]
    for a, b in zip(found, slow, strict=True):
        assert [set(np.flatnonzero(np.unpackbits(x)).tolist()) for x in a] == b
    for x, a in zip(found, slow, strict=True):
        for y, b in zip(found, slow, strict=True):
            if a == b or not a or not b:
                want = float(a == b)
            else:
                score = [[min(1.0, max(0.0, (len(f & g) - len(f) * len(g) / 2048) / max(min(len(f), len(g)) - len(f) * len(g) / 2048, 1e-9))) for g in b] for f in a]
                one, other = sum(map(max, score)) / len(a), sum(map(max, zip(*score, strict=True))) / len(b)
                want = one if len(a) < len(b) else other if len(b) < len(a) else (one + other) / 2
            assert abs(fingerprints.likeness(x, y) - want) < 1e-4


def test_passages_of_edges(edges, rows):
    got = passage_dedup.repeats(edges).collect()
    assert {r.keeper_id for r in got if r.doc_id in (-9, -5, 3) and r.removed} == {-9}
    assert {r.cluster_id for r in got if r.doc_id in (-9, -5, 3)} == {-9}
    assert {(r.first_word, r.end_word) for r in got if r.doc_id == 12 and r.removed} == {(0, 20_000)}
    out = passage_dedup.without_repeats(edges)
    assert out.columns == edges.columns
    by_row = {r.row: r for r in out.collect()}
    assert len(by_row) == len(rows)
    texts = [t for _, t in rows]
    assert by_row[0].text == texts[0] and by_row[1].text.split() == [] and by_row[2].text.split() == ["tail"] and by_row[11].text == texts[11] and by_row[12].text.split() == []
    # Of the texts of one id only the one that counts can be cut, and rows without an id never are.
    assert sum(by_row[k].text != texts[k] for k in (3, 4)) == 0 and all(by_row[k].text == texts[k] for k in (6, 7, 8, 9, 10, 13))
    assert passage_dedup.without_repeats(edges.limit(0)).count() == 0


def test_an_id_with_two_texts_loses_nothing_of_the_other(spark):
    rng = random.Random(21)
    shared, other = sentence(rng, 80), sentence(rng, 201)
    docs = spark.createDataFrame([(1, shared), (2, sentence(rng, 30) + " " + shared), (2, other)], "doc_id long, text string")
    out = {r.text for r in passage_dedup.without_repeats(docs).collect()}
    assert shared in out and other in out


def test_removed_words_are_those_of_windows_in_smaller_documents(spark):
    """Every window of 50 equal words, by brute force; frequent sentences and passages, in many contexts."""
    rng = random.Random(31)
    passages = [sentence(rng, n) for n in (50, 51, 64, 80, 130)] + [sentence(rng, 36)]
    texts = []
    for _ in range(90):
        parts = [sentence(rng, rng.randint(5, 70))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), sentence(rng, rng.randint(3, 60))]
        texts.append(" ".join(parts))
    texts += [passages[5] + " " + sentence(rng, 40) for _ in range(400)]  # a sentence that travels alone
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    first, want = {}, collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if first.setdefault(key, i) != i:
                want[i] |= set(range(k, k + 50))
    got = collections.defaultdict(set)
    for r in passage_dedup.repeats(docs).filter("removed").collect():
        got[r.doc_id] |= set(range(r.first_word, r.end_word))
    assert want and all(want[i] <= got[i] for i in want)
    assert sum(len(got[i] - want[i]) for i in got) <= 0.02 * sum(map(len, want.values()))  # gaps and chance words at the ends


def slow_labels(text):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", t) if x]
    labels, score = set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        if any(w[k : k + len(p)] == p for k in range(len(w))):
            labels.add(label)
            score = 1.0
    k = license_scan.K
    for label, notice in license_scan.NOTICES.items():
        p = notice.split()
        grams = collections.defaultdict(list)
        for j in range(len(p) - k + 1):
            grams[tuple(p[j : j + k])].append(j)
        diagonals = sorted({i - j for i in range(len(w) - k + 1) for j in grams.get(tuple(w[i : i + k]), [])})
        runs = []
        for d in diagonals:
            if runs and d - runs[-1][-1] <= license_scan.NEAR:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            covered = sum(any(0 <= d + j < len(w) and w[d + j] == p[j] for d in range(run[0], run[-1] + 1)) for j in range(len(p))) / len(p)
            if covered >= license_scan.COVERED:
                labels.add(label)
                score = max(score, covered)
    return ",".join(sorted(labels)), score


def test_license_labels_match_the_slow_version(spark, edges, rows):
    rng = random.Random(41)
    texts = []
    for notice in [*license_scan.NOTICES.values(), *license_scan.PHRASES]:
        words = notice.split()
        for _ in range(6):
            some = list(words)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(some) + 1)
                some[at : at + rng.randint(0, 1)] = rng.choice([[], ["zz"], ["Foo", "bar"]])
            texts.append(f"{sentence(rng, rng.randint(0, 20))} {' '.join(some).title()}, {sentence(rng, 10)} {' '.join(words[: rng.randint(0, len(words))])}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scanned(docs).collect():
        labels, score = slow_labels(texts[r.doc_id])
        assert (r.labels, round(r.score, 9)) == (labels, round(score, 9)), texts[r.doc_id]
    got = license_scan.scanned(edges)
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(i for i, _ in rows)
    assert license_scan.scanned(edges.limit(0)).count() == 0


def test_byte_bpe_of_edges_and_random_bytes(spark, edges, rows):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE), special_tokens={})
    got = byte_bpe.encode_documents(edges, BYTE, P.PATTERN)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got.collect()) == collections.Counter((i, len(library.encode_ordinary(t or ""))) for i, t in rows)
    assert byte_bpe.encode_documents(edges.limit(0), BYTE, P.PATTERN).count() == 0
    rng, encoder = random.Random(51), byte_bpe.byte_encoder(BYTE, P.PATTERN)
    ranges = [(0x20, 0x7E), (0xA0, 0x24F), (0x400, 0x4FF), (0x4E00, 0x4FFF), (0x1F300, 0x1F5FF), (0, 0x20)]
    for k in range(1500):
        t = "".join(chr(rng.randint(*rng.choice(ranges if k % 2 else ranges[:2]))) for _ in range(rng.randint(0, 200)))
        t = t if k % 5 else rng.choice("ab 0\n") * rng.randint(1, 3000)
        assert encoder.encode(t) == struct.pack(f"<{len(ids := library.encode_ordinary(t))}I", *ids)
        assert encoder.decode(encoder.encode(t)) == t.encode()


def test_archives_of_edges(spark):
    pages = spark.createDataFrame([(None, "u", "a", 1), (4, "u", "a", 1), (4, "u", "a", 1), (-3, None, "b", 1), (2, "v", "b", 1), (None, "w", "only", 1), (6, "é\n", None, 1), (7, "", "", 1)], "page_id long, url string, html string, payload_sha1 int")
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archived_pages(pages).collect())
    want = [(None, "revisit", 4, 1), (4, "response", None, 1), (4, "response", None, 1), (-3, "response", None, 1), (2, "revisit", -3, 1), (None, "response", None, 4), (6, "response", None, 0), (7, "revisit", 6, 0)]
    assert got == collections.Counter(want)


def test_salvage_is_linear_and_reads_any_field_names():
    for data in (b"\x1f\x8b\x08" * 350_000, b"WARC/1.1\r\n" * 100_000, (warc.MEMBER + b"\0" * 6 + b"\3") * 100_000):
        began = time.process_time()
        assert list(warc.salvage(data)) == [(0, len(data), None)]
        assert time.process_time() - began < 20
    record = warc.record(1, "u", b"abc")
    plain = record.replace(b"Content-Length: 7", b"x").replace(b"WARC-Type: ", b"warc-type:").replace(b"WARC-Payload-Digest", b"warc-payload-DIGEST")
    plain = b"Content-Length:".join(plain.rsplit(b"Content-Length: ", 1)) if plain.count(b"Content-Length: ") == 1 else plain
    assert [x["digest"] for *_, x in warc.salvage(plain)] == [warc.digest(b"abc")]
    # Within a member, gaps leave out what was recovered.
    bad = warc.record(2, "u", b"abd").replace(b"abd\r\n", b"abe\r\n")
    content = record + bad + record
    spans = list(warc.spans(warc.member(content)))
    assert [(a, b, x is None) for *_, a, b, x in spans] == [(0, len(record), False), (len(record), len(record + bad), True), (len(record + bad), len(content), False)]


def test_store_keeps_columns_and_outlives_lost_writers(spark, edges, rows):
    store, version = shards.compacted(edges, arrivals=9, base_bytes=1 << 30)
    back = store.read()
    assert set(back.columns) == {*edges.columns, "shard_"}
    assert collections.Counter(tuple(r) for r in back.select(edges.columns).collect()) == collections.Counter(tuple(r) for r in edges.collect())
    # A writer that is lost before its manifest has its name leaves a temporary file and shards, which stop nobody.
    at = f"{store.root}/manifest/v{version + 1:08d}.json"
    assert write_new(spark, f"{at}.lost.tmp", "half")
    after = store.append(edges.limit(2))
    assert after["version"] > version and store.read().count() == len(rows) + 2
    # Of two writers that saw the same version, the later one fails, and adopt tries again.
    with pytest.raises(shards.Conflict):
        store.commit({"version": after["version"] - 1, "runs": []}, [])
    assert not write_new(spark, f"{store.root}/manifest/v{after['version']:08d}.json", "other")
    stale, real = dict(after, version=after["version"] - 1), store.manifest
    seen = iter([stale])
    store.manifest = lambda *a: next(seen, None) or real(*a)
    store.adopt(store.read().limit(1).inputFiles()[0].rpartition("/")[0])
    del store.manifest
    store.vacuum(orphans_after_s=0)
    assert not any("lost" in x for x in store._names("manifest")) and store.read().count() > len(rows)
