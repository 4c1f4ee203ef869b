"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by normalised bit overlap.

Each 64-byte window has an entropy in 0..1000. A first pass counts entropies over all texts; the rarer a value, the better
its rank, and windows of hardly any entropy are left out as weak. Among every 64 neighbouring windows the best-ranked
(leftmost on ties) gets a vote, also where a text's end cuts the neighbourhood; windows of 16 votes or more are features. A
text's distinct features go, 160 to a filter, into Bloom filters of 2048 bits with five bits for each feature. Likeness
compares each filter of the smaller digest with its best match in the other: overlap above chance, as a part of the most
that is possible. Texts under 64 bytes have one feature, the whole text; the empty text has none.

Contract: null text is empty; the order is doc_id descending with null ids last and equal ids by text, so repeated rows are each
other's next; the last row's next is the first, a single row's next is itself; equal fingerprints have likeness 1, an empty digest
against another 0; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.llm.store import stored
from segmenta.llm.text import byte_columns, mix, powers, slices

WINDOW, VOTES, PER_FILTER, BITS, WEAK = 64, 16, 160, 2048, 100
_BLOCK = 1 << 18
_GAIN = np.array([0.0] + [c * np.log2(c) if c else 0.0 for c in range(1, WINDOW + 1)])
#: c * log2(c) in whole units, so that running sums are exact.
_UNITS = np.round(_GAIN * (1 << 20)).astype(np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy in 0..1000 of the window from each byte on, by sliding counts; one value per whole window."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same  # equal bytes among the 63 before
        after[:-lag] += same  # and among the 63 after
    gain = np.diff(_UNITS)
    enters = gain[before]
    total = np.cumsum(enters)
    leaves = np.cumsum(gain[after])
    sums = total[WINDOW - 1 :].copy()
    sums[1:] -= leaves[: n - WINDOW]
    return np.clip(((6 * WINDOW << 20) - sums) * 1000 // (6 * WINDOW << 20), 0, 1000)


def _starts(offsets: np.ndarray) -> np.ndarray:
    """Which bytes begin a window that ends in the same text."""
    whole = np.zeros(int(offsets[-1]) + 1, np.int32)
    long = np.diff(offsets) >= WINDOW
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[1:][long] - WINDOW + 1, -1)
    return np.cumsum(whole[:-1]) > 0


def ranks_by_rarity(histogram: np.ndarray) -> np.ndarray:
    """A rank for each entropy, 0 the rarest; weak ones have none (-1). Values never seen rank as rarest, by value."""
    ranks = np.full(1001, -1, np.int64)
    strong = np.arange(WEAK, 1001)
    ranks[strong[np.lexsort((strong, histogram[strong]))]] = np.arange(len(strong))
    return ranks


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash), distinct in each text and in the order of their places."""
    n, none = len(data), np.int64(1) << 60
    out_text, out_hash = [], []
    if n >= WINDOW:
        key = np.full(n + 2 * WINDOW, none)
        starts = _starts(offsets)[: n - WINDOW + 1]
        rank = np.where(starts, ranks[entropies(data)], -1)
        at = np.arange(WINDOW, WINDOW + len(rank))
        key[at] = np.where(rank >= 0, (rank << 40) | at, none)
        best, width = key, 1
        while width < WINDOW:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = best[best < none]
        votes = np.bincount(best & ((np.int64(1) << 40) - 1), minlength=len(key))
        chosen = np.flatnonzero(votes >= VOTES) - WINDOW
        if len(chosen):
            bytes_of = data[chosen[:, None] + np.arange(WINDOW)].astype(np.uint64) + np.uint64(1)
            out_text.append(np.searchsorted(offsets, chosen, "right") - 1)
            out_hash.append(mix((bytes_of * powers(WINDOW)[:WINDOW]).sum(1, dtype=np.uint64)))
    lengths = np.diff(offsets)
    for k in np.flatnonzero((lengths > 0) & (lengths < WINDOW)).tolist():
        whole = data[offsets[k] : offsets[k + 1]].astype(np.uint64) + np.uint64(1)
        out_text.append(np.array([k]))
        out_hash.append(mix((whole * powers(WINDOW)[: len(whole)]).sum(keepdims=True, dtype=np.uint64)))
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, h = np.concatenate(out_text), np.concatenate(out_hash)
    order = np.lexsort((np.arange(len(text)), h, text))
    fresh = np.append(True, (text[order][1:] != text[order][:-1]) | (h[order][1:] != h[order][:-1]))
    kept = np.sort(order[fresh])
    kept = kept[np.argsort(text[kept], kind="stable")]
    return text[kept], h[kept]


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, one row of 256 bytes for each."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(x) for x in texts])).astype(np.int64)
    text, h = features(data, offsets, ranks)
    count = np.bincount(text, minlength=len(texts))
    filters = -(-count // PER_FILTER)
    first = np.cumsum(filters) - filters
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    row = first[text] + nth // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(5):
        bits[row, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + n] for a, n in zip(first.tolist(), filters.tolist(), strict=True)]


def shown(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    nx, ny = x.sum(1)[:, None], y.sum(1)[None, :]
    chance, most = nx * ny / BITS, np.minimum(nx, ny)
    score = np.clip((x @ y.T - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    one, other = float(score.max(1).mean()), float(score.max(0).mean())
    return round(one if len(a) < len(b) else other if len(b) < len(a) else (one + other) / 2, 6)


def _compared(rows: list[tuple[int | None, str, str]], ranks: np.ndarray) -> list[tuple]:
    """Result rows of (doc_id, text, next text)."""
    out = []
    for a in range(0, len(rows), 64):
        some = rows[a : a + 64]
        edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, nxt in some]
        whole = [t.encode() for _, t, _ in some]
        changed = [t.encode() for t in edited]
        # Usually a row's next text is the row after it; a text is digested once for both.
        follow = [some[k + 1][1] is some[k][2] if k + 1 < len(some) else False for k in range(len(some))]
        extra = [k for k in range(len(some)) if not follow[k]]
        found = digests(whole + changed + [some[k][2].encode() for k in extra], ranks)
        n = len(some)
        nexts = {k: found[2 * n + i] for i, k in enumerate(extra)}
        for k, (doc, t, _) in enumerate(some):
            after = nexts.get(k, found[k + 1] if k + 1 < n else None)
            out.append((doc, len(t), hashlib.sha256(changed[k]).hexdigest(), shown(found[k]), shown(found[n + k]), likeness(found[k], found[n + k]), likeness(found[k], after)))
    return out


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def entropy_histogram(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each entropy; 1001 numbers."""

    def count(batches):
        total = np.zeros(1001, np.int64)
        for batch in batches:
            for rows in slices(batch, "text", _BLOCK):
                data, offsets = byte_columns(rows.column("text"))
                if len(data) >= WINDOW:
                    total += np.bincount(entropies(data)[_starts(offsets)[: len(data) - WINDOW + 1]], minlength=1001)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"entropy": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    out = np.zeros(1001, np.int64)
    for r in docs.select("text").mapInArrow(count, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        out[r.entropy] = r.n
    return out


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id and fingerprint of each text; no shuffle. ranks: of an earlier corpus, to compare with its fingerprints."""
    ranks = ranks_by_rarity(entropy_histogram(docs)) if ranks is None else ranks

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "text", _BLOCK):
                found = digests([(x or "").encode() for x in rows.column("text").to_pylist()], ranks)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([shown(x) for x in found], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how near each is to those and to the next text.

    One range shuffle brings the documents in order; each task then runs along its rows. What a task's last row needs, the
    first text of the next task, is joined to it afterwards: a row per task.
    """
    ranks = ranks_by_rarity(entropy_histogram(docs))

    def run(batches):
        part, held, first = TaskContext.get().partitionId(), None, True

        def sent(done, role=None, doc=None, text=None):
            cols = list(zip(*done, strict=True)) if done else [[]] * 7
            n = len(done)
            if role:
                cols, n = [[doc], [None], [None], [None], [None], [None], [None]], 1
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, _KINDS, strict=True)] + [pa.array([part] * n, pa.int32()), pa.array([role] * n, pa.string()), pa.array([text] * n, pa.string())], [*_NAMES, "part", "role", "text"])

        for batch in batches:
            for rows in slices(batch, "text", _BLOCK):
                pairs = []
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    text = text or ""
                    if first:
                        yield sent([], "first", doc, text)
                        first = False
                    if held:
                        pairs.append((*held, text))
                    held = (doc, text)
                if pairs:
                    yield sent(_compared(pairs, ranks))
        if held:
            yield sent([], "last", *held)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")
    rows = stored(ordered.mapInArrow(run, f"{_DDL}, part int, role string, text string"), "compared")
    heads = rows.filter("role = 'first'").select("part", F.col("text").alias("next_text"))
    after = heads.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    last = rows.filter("role = 'last'").select("part", "doc_id", "text").join(after, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")

    def close(batches):
        for batch in batches:
            done = _compared([(d, t or "", n or "") for d, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True)], ranks)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), _KINDS, strict=True)], _NAMES)

    return rows.filter("role is null").select(*_NAMES).unionByName(last.mapInArrow(close, _DDL))
