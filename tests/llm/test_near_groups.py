"""Near-duplicate classes beside all pairs, for groups of copies that differ about as much as is still similar."""

import itertools
import random

import numpy as np

from segmenta.llm import near_dedup
from segmenta.llm.sketch import count_sketch
from segmenta.llm.text import byte_columns, word_hashes
from tests.llm.test_operators import sentence


def test_classes_of_large_groups_match_all_pairs(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "BLOCK", 32)  # buckets are dealt to several tasks
    monkeypatch.setattr(near_dedup, "NEAREST", 1)  # and take several rounds
    rng = random.Random(71)
    texts = []
    for size, words in ((150, 140), (60, 300), (20, 60)):
        base = sentence(rng, words).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, words // 40))):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            texts.append(" ".join(w))
    texts += [sentence(rng, rng.randint(5, 200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    weights = near_dedup.Weights(count_sketch(docs.select("text"), near_dedup._distinct_shingles, near_dedup.SKETCH_BITS), len(texts))
    words, first = word_hashes(*byte_columns(pa.array(texts)))
    sets = [weights.of(words[first[k] : first[k + 1]]) for k in range(len(texts))]
    linked = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near_dedup.similar(sets[i], sets[j], weights)}
    apart = {(i, j) for i, j in itertools.combinations(range(230), 2)} - linked
    assert len(linked) > 500 and len(apart) > 5000
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    together = sum(got[i] == got[j] for i, j in linked)
    assert together >= 0.98 * len(linked)
    # No class holds texts that links don't connect.
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in sorted(linked):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert all(root(i) == root(got[i]) for i in got)


def test_rounds_name_every_allowed_pair():
    """Over rounds of growing limits, each pair of different components that the bitmaps allow is given once."""
    rng = np.random.default_rng(5)
    n = 60
    base = rng.random(512) < 0.3
    bits = [base ^ (rng.random(512) < 0.02) for _ in range(n)]
    maps = [np.packbits(b, bitorder="little").tobytes() for b in bits]
    totals = np.full(n, 400.0)
    none = [b"\0" * 64] * n
    i, j, distance = near_dedup.allowed(maps, none, totals, totals, np.arange(n))
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if (bits[a] != bits[b]).sum() <= 800 / 9 * (1 + 1e-5)}
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want and len(want) > 500
    seen: set = set()
    for limit in (1, 16, 256):
        some = near_dedup.nearest(i, j, distance, limit)
        seen |= set(some.tolist())
    assert len(seen) == len(i)
    folded = near_dedup.folded(np.frombuffer(maps[0], np.uint64)[None])
    assert (np.unpackbits(folded.view(np.uint8), bitorder="little") == (bits[0][:256] ^ bits[0][256:])).all()
