"""The corpus pipeline as a whole beside a plain version of its stages."""

import collections
import random
import struct
import zlib

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from segmenta.llm import quality_rules
from tests.llm.test_operators import sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(61)
    passages = [sentence(rng, n) for n in (55, 70, 120)]
    texts = []
    for k in range(160):
        t = sentence(rng, rng.randint(30, 160))
        if k % 6 == 0:
            t += " " + rng.choice(passages) + " " + sentence(rng, rng.randint(5, 40))
        if k % 4 == 1:
            t = "! ".join(t.split()) + "!"  # what the labels call bad
        texts.append(t)
    texts += [texts[0], texts[2].replace(texts[2].split()[10], "zzz", 1), None, "", "too short", "same line again and again\n" * 30, " ".join(sentence(rng, 12) for _ in range(2)) + " " + passages[2]]
    rows = [(k * 3 - 30, t, "en", "s", len(t or ""), k) for k, t in enumerate(texts)] + [(None, texts[4], "en", "s", len(texts[4]), -1)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k * 3 - 30, int(k % 4 != 1), 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def plain_quality(spark, at, rows):
    docs, labels = (spark.read.parquet(f"{at}/{x}.parquet") for x in ("documents", "labels"))
    rules, names = quality_rules.trained(docs, labels), quality_rules.features()
    assert rules
    stats = {r.input_kept: r for r in quality_rules.judged(docs, labels).select("input_kept", "n_words", "n_repeat_words", *[c.alias(f"f_{k}") for k, c in names.items()]).collect()}
    out = []
    for r in rows:
        w = (r[1] or "").split()
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        s = {k: stats[r[5]][f"f_{k}"] for k in names}
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w) and not any(all(t.holds(s) for t in rule) for rule in rules):
            out.append(r)
    return out


def plain_near(rows):
    sets = [{tuple(r[1].split()[k : k + 5]) for k in range(len(r[1].split()) - 4)} for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    classes = collections.defaultdict(list)
    for i, r in enumerate(rows):
        classes[root(i)].append(r)
    return [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]


def plain_passages(rows):
    first, out = {}, {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = r[1].split()
        gone = set()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if first.setdefault(key, r[0]) != r[0]:
                gone |= set(range(k, k + 50))
        out[r[0]] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages_match_plain_versions(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        tables.append((docs.columns, docs.collect()))
        docs = spark.createDataFrame(tables[-1][1], docs.schema)
    (columns, kept), (_, once), (_, cut), (_, packed) = tables
    assert columns == tables[1][0] == tables[2][0] == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    good = plain_quality(spark, at, rows)
    assert collections.Counter(tuple(r) for r in kept) == collections.Counter(good) and len(good) < len(rows) - 20
    near = plain_near(good)
    assert {r.kept for r in once} == {r[5] for r in near} and len(near) < len(good)
    words = plain_passages(near)
    assert {r.doc_id: r.text.split() for r in cut if r.doc_id is not None} == words and any(len(r.text.split()) < len(t[1].split()) for r in cut for t in near if t[5] == r.kept)
    assert all(r.n_chars == len(r.text) for r in cut)
    library, pieces, fill = Tokenizer.from_file(P.path("word_bpe_49k.json")), collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    for d in cut:
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 0]
        assert [r.ids_crc32 for r in sorted(pieces[d.doc_id], key=lambda r: r.piece)] == [zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for x in (ids[a : a + 2048] for a in range(0, len(ids), 2048))]
    assert all(o == sum(n for _, n in sorted(s)[:k]) for s in fill.values() for k, (o, _) in enumerate(sorted(s)))


def test_run_writes_every_stage_and_takes_empty_tables(spark, folder, tmp_path):
    at, rows = folder
    assert corpus_pipeline.run(spark, at).count() >= 40
    empty = str(tmp_path)
    for x in ("documents", "labels"):
        spark.read.parquet(f"{at}/{x}.parquet").limit(0).write.parquet(f"{empty}/{x}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
