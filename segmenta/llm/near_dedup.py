"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles are counted over all texts in a table of fixed size; the mean load of a slot
   is taken off, so rare shingles keep a frequency near one at any corpus size. A shingle weighs tf * idf with
   idf = 1 + IDF_SPAN * ln((1 + N) / (1 + df)) / ln(1 + N); the span keeps large groups of copies, whose shared shingles are
   frequent, from falling apart.
2. Each text draws ``SAMPLES`` weighted samples (ICWS): for a shingle's r, c ~ Gamma(2, 1) and beta ~ U(0, 1), fixed by its
   slots in tables, t = floor(ln w / r + beta) and ln a = ln c - r (t - beta) - r; the least a wins, and (shingle, t) is the
   sample. Two texts draw the same sample with the probability of their weighted Jaccard similarity.
3. Texts that agree on all ``ROWS`` samples of a band are candidates. In a bucket every text is compared with four pivots,
   not with all. Buckets that then still hold several components stay open, and go through rounds: each text names the ``NEAREST``
   nearest of other components in its bucket whose bitmaps allow the similarity (16 times as many in each further round), those
   pairs are verified, components contract, until no text has an allowed partner that it didn't name. Bits that differ are
   elements that differ, so the bound loses no pair; bitmaps grow with their texts, so it is sharp at any length. What a bucket's
   texts have in common with their own component is never compared. Buckets of more than ``BLOCK`` texts are dealt to tasks
   as pairs of blocks.
4. Candidates are verified by their exact weighted Jaccard similarity on whole texts. idf weighs two texts' differences more
   than what a large group of copies shares, so a pair whose similarity by tf alone is high enough is a link as well.
   Classes are the components.

Equal texts are one node from the start. Contract: a null text is empty; texts of fewer than five words have one shingle of
all their words; texts without words are near only to equal texts; class_id is the least doc_id of the class (null only if
all are) and class_digest the text of its keeper, which tells classes apart where one id has two texts; one row of each class
is the keeper, also among repeated rows; an empty table gives no rows; ``near_classes`` ignores extra columns, ``deduplicated``
keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.components import components
from segmenta.llm.sketch import count_sketch
from segmenta.llm.store import drop, stored
from segmenta.llm.text import byte_columns, mix, shingles, slices, word_hashes

SIMILARITY, ROWS, BANDS = 0.8, 5, 16
SAMPLES = ROWS * BANDS
IDF_SPAN = 0.25
#: Bits of the map that bounds how much two texts can share, for a total weight of up to twice as much; it doubles with it.
BITMAP = 512
#: Shingles of at least this idf have a second map; what differs there weighs as much at least.
RARE = 1.15
#: Partners that a text of an open bucket names in the first round; texts of a block of a bucket.
NEAREST, BLOCK = 4, 1024
SKETCH_BITS, _SLOTS = 20, 1 << 14
#: Ids up to this number may be broadcast (8 bytes each); beyond it the same join is shuffled.
SMALL = 1 << 20


def _each_text(batch: pa.RecordBatch):
    """(row, word hashes) of each text of a batch."""
    done = 0
    for rows in slices(batch, "text"):
        words, first = word_hashes(*byte_columns(rows.column("text")))
        for k in range(rows.num_rows):
            yield done + k, words[first[k] : first[k + 1]]
        done += rows.num_rows


def _distinct_shingles(batch: pa.RecordBatch) -> np.ndarray:
    found = [np.unique(shingles(w)) for _, w in _each_text(batch)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class Weights:
    """TF-IDF weights of a text's shingles."""

    def __init__(self, sketch: np.ndarray, n_docs: int):
        noise = sketch.sum() / len(sketch)
        df = np.clip((sketch - noise) * len(sketch) / (len(sketch) - 1), 1, max(1, n_docs))
        self.idf = (1 + IDF_SPAN * np.log((1 + n_docs) / (1 + df)) / np.log(max(2, 1 + n_docs))).astype(np.float32)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in rising order and their weights."""
        h, n = np.unique(shingles(words), return_counts=True)
        return h, n.astype(np.float32) * self.idf[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]

    def tf(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h, np.rint(w / self.idf[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    top = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - low
    return low / top if top else 0.0


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> bool:
    return weighted_jaccard(a, b) >= SIMILARITY or weighted_jaccard(weights.tf(*a), weights.tf(*b)) >= SIMILARITY


@lru_cache(1)
def _draws() -> tuple[np.ndarray, ...]:
    rng = np.random.Generator(np.random.PCG64(42))
    r, c = (rng.gamma(2, 1, (_SLOTS, SAMPLES)).astype(np.float32) for _ in range(2))
    beta = rng.random((_SLOTS, SAMPLES), np.float32)
    return r, 1 / r, beta, np.log(c)


def samples(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted samples of a set, as 64-bit hashes of (shingle, t)."""
    r, over_r, beta, ln_c = _draws()
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    all_k = np.arange(SAMPLES)
    ln_w = np.log(weight)[:, None]
    for a in range(0, len(h), 4096):
        some = h[a : a + 4096]
        # r, beta and c by different bits: two shingles share all three only if they share 42 bits.
        bits = mix(some.copy())
        one, two, three = ((bits >> np.uint64(k)).astype(np.int64) & (_SLOTS - 1) for k in (0, 14, 28))
        r_one, beta_two = r[one], beta[two]
        t = np.floor(ln_w[a : a + 4096] * over_r[one] + beta_two)
        ln_a = ln_c[three] - r_one * (t - beta_two + 1)
        at = ln_a.argmin(0)
        low = ln_a[at, all_k]
        better = low < best
        sample = mix(some[at] ^ (t[at, all_k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out[better], best[better] = sample[better], low[better]
    return out


def band_keys(drawn: np.ndarray) -> np.ndarray:
    x = drawn.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0xFF51AFD7ED558CCD) ^ x[:, k])
    return key.view(np.int64)


def picked(rows: DataFrame, ids: DataFrame, key: str, kind: str = "left_semi") -> DataFrame:
    """Join by ids; broadcast only after counting that they are few, shuffled otherwise."""
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL else ids, key, kind)


def _signatures(docs: DataFrame, weights) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for _, words in _each_text(batch):
                h, w = weights.value.of(words)
                drawn = samples(h, w) if len(h) else np.zeros(0, np.uint64)
                out.append(band_keys(drawn) if len(h) else np.zeros(0, np.int64))
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashlib.md5(x).hexdigest() for x in texts], pa.string()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, digest string, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar enough."""

    def run(batches):
        known: tuple = (None, None)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sets = [weights.value.of(w) for _, w in _each_text(batch.select(["ta"]).rename_columns(["text"]))]
            texts_b, keep = batch.column("tb"), []
            for k in range(len(a)):
                if b[k] != known[0]:  # rows come sorted by b
                    words, _ = word_hashes(*byte_columns(texts_b.slice(k, 1)))
                    known = (b[k], weights.value.of(words))
                keep.append(similar(sets[k], known[1], weights.value))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(a, keep, strict=True) if y], pa.string()), pa.array([x for x, y in zip(b, keep, strict=True) if y], pa.string())], ["a", "b"])

    ta, tb = texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")), texts.select(F.col("digest").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").sortWithinPartitions("b").mapInArrow(run, "a string, b string")


def bitmap(h: np.ndarray, w: np.ndarray, weights: Weights, bits: int | None = None) -> np.ndarray:
    """The parity of the elements (shingle, occurrence) that fall on each bit, as 64-bit words."""
    n = weights.tf(h, w)[1].astype(np.int64)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if bits is None:
        bits = BITMAP
        while bits * 2 < w.sum(dtype=np.float64):
            bits *= 2
    at = mix(np.repeat(h, n) ^ mix(nth.astype(np.uint64) + np.uint64(1))) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.uint64)


def folded(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits."""
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def may_be_similar(one: np.ndarray, others: np.ndarray, weight: float, weights_of: np.ndarray) -> np.ndarray:
    """Which of the others may be as similar as SIMILARITY to one, by bitmaps and total weights; never false for a pair that is.

    Elements weigh at least 1, so the sets differ in at least as much weight as their bitmaps in bits, and with a total
    weight of W and a difference of D the similarity is (W - D) / (W + D). By tf alone W is less, so this bounds both.
    """
    differ = np.bitwise_count(others ^ one).sum(1, dtype=np.int64)
    return differ <= (weight + weights_of) * ((1 - SIMILARITY) / (1 + SIMILARITY)) * (1 + 1e-5)


def _sketched(texts: DataFrame, weights) -> DataFrame:
    """Of each text its digest, bitmap, bitmap of rare shingles, total weight and total by tf alone."""

    def run(batches):
        for batch in batches:
            maps, rare, totals, counts = [], [], [], []
            for _, words in _each_text(batch):
                h, w = weights.value.of(words)
                n = weights.value.tf(h, w)[1]
                few = w >= RARE * n * (1 + 1e-6)
                maps.append(bitmap(h, w, weights.value))
                rare.append(bitmap(h[few], w[few], weights.value, 64 * len(maps[-1])).tobytes())
                totals.append(float(w.sum(dtype=np.float64)))
                counts.append(float(n.sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([x.tobytes() for x in maps], pa.binary()), pa.array(rare, pa.binary()), pa.array(totals, pa.float64()), pa.array(counts, pa.float64())], ["digest", "bitmap", "rare", "total", "elements"])

    return texts.select("digest", "text").mapInArrow(run, "digest string, bitmap binary, rare binary, total double, elements double")


def allowed(maps: list[bytes], rare: list[bytes], totals: np.ndarray, elements: np.ndarray, comps: np.ndarray, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of all pairs of different components (and blocks, where given) whose bitmaps allow the similarity."""
    sizes = np.array([len(x) for x in maps])
    found = []
    # Totals of similar texts are less than a factor of two apart, so their maps are equally long or one is twice the other.
    for size in np.unique(sizes):
        own, twice = np.flatnonzero(sizes == size), np.flatnonzero(sizes == 2 * size)
        at = np.concatenate([own, twice])
        rows, few = (np.frombuffer(b"".join([x[k] for k in own]), np.uint64).reshape(len(own), -1) for x in (maps, rare))
        if len(twice):
            rows, few = (np.concatenate([x, folded(np.frombuffer(b"".join([y[k] for k in twice]), np.uint64).reshape(len(twice), -1))]) for x, y in ((rows, maps), (few, rare)))
        for k, i in enumerate(own.tolist()):
            others = at[k + 1 :]
            some = np.flatnonzero((comps[others] != comps[i]) if blocks is None else (comps[others] != comps[i]) & (blocks[others] != blocks[i]))
            if not len(some):
                continue
            some = some[may_be_similar(rows[k], rows[k + 1 :][some], totals[i], totals[others[some]])]
            j = others[some]
            differ = np.bitwise_count(rows[k + 1 :][some] ^ rows[k]).sum(1, dtype=np.int64)
            heavy = differ + (RARE - 1) * np.bitwise_count(few[k + 1 :][some] ^ few[k]).sum(1, dtype=np.int64)
            # By weight, or else by tf alone.
            most = (1 - SIMILARITY) / (1 + SIMILARITY) * (1 + 1e-5)
            near = (heavy <= (totals[i] + totals[j]) * most) | (differ <= (elements[i] + elements[j]) * most)
            if near.any():
                found.append((np.full(int(near.sum()), i), j[near], heavy[near] / (totals[i] + totals[j[near]])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(i: np.ndarray, j: np.ndarray, distance: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs are among the ``limit`` nearest of either of their texts."""
    who, at = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((at, distance[at], who))
    first = np.append(True, who[order][1:] != who[order][:-1])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return np.unique(at[order[nth < limit]])


def _candidates(members: DataFrame, sketches: DataFrame, nodes: DataFrame | None, limit: int | None, before: int = 0) -> DataFrame:
    """Pairs (a, b) of members (key, digest, comp) that share a key, differ in comp and may be similar by bitmap; each text's
    ``limit`` nearest of a block, and a row of nulls where a block has more. nodes: the bands of each digest; with them a pair
    comes from its first common bucket alone. before: the limit of the round before, whose components members have as ``was``;
    what it gave isn't given again (components only grow, so that holds for all rounds before)."""

    banded = nodes is not None

    def meet(batches):
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            digests, comps, was = table.column("digest").to_pylist(), table.column("comp").to_numpy(), table.column("was").to_numpy()
            lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
            i, j, distance = allowed(table.column("bitmap").to_pylist(), table.column("rare").to_pylist(), table.column("total").to_numpy(), table.column("elements").to_numpy(), was, None if lo == hi else table.column("block").to_numpy())
            if banded and len(i):
                bands, key = np.stack(table.column("bands").to_pylist()), table.column("key")[0].as_py()
                same = bands[i] == bands[j]
                here = bands[i, same.argmax(1)] == key
                i, j, distance = i[here], j[here], distance[here]
            more, given = False, np.zeros(len(i), bool)
            if before and len(i):
                given[nearest(i, j, distance, before)] = True
            apart = comps[i] != comps[j]
            i, j, distance, given = (x[apart] for x in (i, j, distance, given))
            if limit is not None and len(i):
                some = nearest(i, j, distance, limit)
                more = len(some) < len(i)
                some = some[~given[some]]
                i, j = i[some], j[some]
            out = [sorted((digests[x], digests[y]), reverse=True) for x, y in zip(i.tolist(), j.tolist(), strict=True)] + [(None, None)] * more
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = (np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in ("key", "lo", "hi")):
                    if sum(x.num_rows for x in held) > 1:
                        yield pairs(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if sum(x.num_rows for x in held) > 1:
            yield pairs(pa.Table.from_batches(held))

    spread = members.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("c0 <> c1").select("key", "blocks")
    spread = stored(spread, "open-buckets")  # a table of its own, so that the join can be split where a bucket is large
    rows = members.join(spread, "key").join(sketches, "digest")
    if banded:
        rows = rows.join(nodes.select("digest", "bands"), "digest")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "digest", F.xxhash64("comp").alias("comp"), F.xxhash64("was" if before else "comp").alias("was"), "bitmap", "rare", "total", "elements", *["bands"] * banded)
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(meet, "a string, b string")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnsRenamed({"node": "digest", "root": "comp"}), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))


def _across(members: DataFrame, links: DataFrame, texts: DataFrame, weights, nodes: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Candidates (a, b) in different components of open buckets; members: key, digest."""
    return _candidates(_rooted(members, components(links)), _sketched(texts, weights), nodes, limit)


def near_classes(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, digest (of the text), class_id, class_digest and keeper (true for one row of each class)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = count_sketch(docs.select("text"), _distinct_shingles, SKETCH_BITS)
    weights = spark.sparkContext.broadcast(Weights(sketch, docs.count()))  # 2**SKETCH_BITS numbers
    marked = stored(_signatures(docs, weights).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # One node for each distinct text.
    nodes = stored(marked.groupBy("digest").agg(F.first("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "row")).alias("first")), "texts-once")
    members = nodes.select("digest", F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.min_by("digest", F.xxhash64("digest", "key")).alias("p"), F.max_by("digest", F.xxhash64("digest", "key")).alias("q")).filter("lo <> hi")
    buckets = stored(members.join(ends, "key"), "buckets")
    near = lambda p: buckets.filter(f"digest <> {p}").select(F.greatest("digest", p).alias("a"), F.least("digest", p).alias("b"))
    pairs = stored(near("lo").unionByName(near("hi")).unionByName(near("p")).unionByName(near("q")).distinct(), "pairs")
    members = buckets.select("key", "digest")
    by_digest = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")
    texts = stored(picked(by_digest, members.select("digest").distinct(), "digest").groupBy("digest").agg(F.first("text").alias("text")), "texts")
    links = stored(_verified(pairs, texts, weights), "links")
    roots = components(links)
    # Rounds: the state is the components now and in the round before.
    limit, before, was, spent, sketches = NEAREST, 0, None, [buckets, pairs, texts, links], None
    while True:
        rooted = _rooted(members, roots)
        if sketches is None:
            opened = rooted.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key")
            members = stored(members.join(stored(opened, "open-keys"), "key", "left_semi"), "open-members")
            sketches = stored(_sketched(picked(texts, members.select("digest").distinct(), "digest"), weights), "sketches")
            rooted = _rooted(members, roots)
            spent += [members, sketches]
        if was is not None:
            rooted = _rooted(rooted.withColumnRenamed("comp", "now"), was).withColumnsRenamed({"comp": "was", "now": "comp"})
        found = stored(_candidates(rooted, sketches, nodes, limit, before), "candidates")
        fresh = stored(found.filter("a is not null").join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        links = stored(_verified(fresh, texts, weights), "more-links")
        spent += [found, fresh, links, roots]
        was = roots
        if links.limit(1).count():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
        if not found.filter("a is null").limit(1).count():
            break
        limit, before = limit * 16, limit
    firsts = stored(_rooted(nodes.select("digest", "first"), roots), "firsts")
    least = stored(firsts.groupBy("comp").agg(F.min("first").alias("least")), "classes")
    of = stored(firsts.select("digest", "comp").join(least, "comp").select("digest", F.col("least.doc_id").alias("class_id"), F.col("least.digest").alias("class_digest"), F.col("least.row").alias("kept")), "class-of-text")
    drop(nodes, firsts, least, roots, *spent)
    return marked.select("doc_id", "digest", "row").join(of, "digest").select("doc_id", "digest", "class_id", "class_digest", (F.col("row") == F.col("kept")).alias("keeper"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of docs; of repeated rows, any one."""
    found = near_classes(docs)
    kept = stored(found.filter("keeper").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")), "keepers")
    repeated = stored(found.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-rows")
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_text"))
    ids = F.broadcast(kept) if kept.count() <= SMALL // 8 else kept
    out = row.join(ids, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_digest")), "left_semi")
    if repeated.limit(1).count():  # the same id and text more than once
        out = out.dropDuplicates(["_id", "_text"])
    return out.select("_row.*")
