"""Token-ID output: shards of ids compressed by a Re-Pair grammar, with random access by id range.

A shard is one immutable file. Its pairs of neighbours are counted once; rounds replace all frequent pairs by new
nonterminals (of two that overlap, the more frequent) and count again only beside what was replaced, until no pair is met
``LEAST`` times. Rules, the expansion length of each nonterminal, and the number of
ids before each block of symbols are stored, so that ``Shard.ids(a, b)`` expands only the blocks it needs.

Contract: documents in ascending doc_id order (null ids first; rows with the same id by text), a null text is empty, every
document ends with the end id, repeated rows are written as often as they come, columns other than ``doc_id`` and ``text``,
whatever their names, are ignored, an empty table gives no shards.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.llm.encoding import word_encoder
from segmenta.llm.store import atomic_file, new_folder, stored
from segmenta.llm.text import slices

MAGIC = b"RPSHARD1"
SHARD_IDS = 1 << 20
LEAST = 8
BLOCK = 1 << 14
_TABLE_BITS = 20


def _spread(pairs: np.ndarray) -> np.ndarray:
    return ((pairs ^ (pairs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)


def _frequent(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs are met at least so often, the number of each, and the numbers' pairs, most frequent first."""
    if len(pairs) >> _TABLE_BITS - 3:
        slot = _spread(pairs).view(np.int64)
        some = np.flatnonzero((np.bincount(slot, minlength=1 << _TABLE_BITS) >= least)[slot])  # pairs whose slot is rare are rare
        order = some[np.argsort(pairs[some])]
    else:
        order = np.argsort(pairs)
    ordered = pairs[order]
    edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, np.int64)
    n = np.diff(np.append(edges, len(order)))
    by_count = np.lexsort((ordered[edges], -n))
    by_count = by_count[: int((n >= least).sum())]
    rank = np.full(len(edges), -1, np.int32)
    rank[by_count] = np.arange(len(by_count))
    number = np.full(len(pairs), -1, np.int32)
    number[order] = np.repeat(rank, n)
    met = np.flatnonzero(number >= 0)
    return met, number[met], ordered[edges[by_count]]


def _apart(at: np.ndarray, number: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Places whose pairs don't overlap, as many as there are: of those that do, the more frequent goes first, of one pair every
    other place."""
    near = np.append(after[at[:-1]] == at[1:], False)  # overlaps the next
    same = np.append(False, near[:-1] & (number[1:] == number[:-1]))
    i = np.arange(len(at))
    free = (i - np.maximum.accumulate(np.where(same, 0, i))) % 2 == 0 if same.any() else np.ones(len(at), bool)
    out, left = [], np.flatnonzero(free)
    while len(left):
        beside = near[left[:-1]] & (left[1:] == left[:-1] + 1)
        wins = np.ones(len(left), bool)
        wins[1:] &= ~(beside & (number[left[:-1]] < number[left[1:]]))
        wins[:-1] &= ~(beside & (number[left[1:]] < number[left[:-1]]))
        won = left[wins]
        out.append(won)
        free[won] = False
        free[won[near[won]] + 1] = False
        before = won[won > 0] - 1
        free[before[near[before]]] = False
        left = left[free[left]]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules [n, 2], base): symbol ``base + k`` stands for the two symbols of rule k.

    All pairs are counted once. A round replaces the frequent pairs, the more frequent first where two overlap; after it only
    places beside a new symbol, and those of a frequent pair that lost to another, can hold a frequent pair, so the next round
    counts these alone. It ends when no pair is met ``least`` times.
    """
    s, n = ids.astype(np.uint32), len(ids)
    base = int(s.max()) + 1 if n else 0
    rules: list[np.ndarray] = []
    known = 0
    # A list of symbols: what is gone is left out by its neighbours.
    after, before, there = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.ones(n, bool)
    at = np.arange(max(0, n - 1))
    while len(at) >= least:
        met, number, pairs = _frequent((s[at].astype(np.uint64) << np.uint64(32)) | s[after[at]], least)
        if not len(met):
            break
        at = at[met]
        chosen = _apart(at, number, after)
        use = np.bincount(number[chosen], minlength=len(pairs))
        kept = use >= least // 2  # the most frequent always is
        chosen = chosen[kept[number[chosen]]]
        rules.append(np.stack([pairs[kept] >> np.uint64(32), pairs[kept] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        here = at[chosen]
        gone = after[here]
        s[here] = (base + known + (np.cumsum(kept) - 1)[number[chosen]]).astype(np.uint32)
        known += int(kept.sum())
        after[here] = after[gone]
        before[after[gone]] = here
        there[gone] = False
        active = np.zeros(n + 1, bool)
        active[at] = True  # frequent, and perhaps still there
        active[gone] = False
        active[here] = active[before[here]] = True
        at = np.flatnonzero(active[:n])
        at = at[after[at] < n]
    return s[there], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; each pass is right for one level more."""
    each = np.full(base + len(rules), 1, np.int64)
    while True:
        after = each[rules[:, 0]] + each[rules[:, 1]]
        if (after == each[base:]).all():
            return after
        each[base:] = after


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for; each pass puts the ids in their places and splits the nonterminals that are left."""
    lengths = expansion_lengths(rules, base) if lengths is None else lengths
    each = np.ones(len(symbols), np.int64)
    deep = symbols >= base
    each[deep] = lengths[symbols[deep] - base]
    at = np.cumsum(each) - each
    out = np.empty(int(each.sum()), np.uint32)
    while len(symbols):
        deep = symbols >= base
        out[at[~deep]] = symbols[~deep]
        pair, at = rules[symbols[deep] - base], at[deep]
        left = pair[:, 0]
        n = np.ones(len(left), np.int64)
        more = left >= base
        n[more] = lengths[left[more] - base]
        symbols, at = np.concatenate([left, pair[:, 1]]), np.concatenate([at, at + n])
    return out


def pack_shard(doc_ids: list[int | None], documents: list[bytes]) -> bytes:
    return packed(doc_ids, documents)[0]


def packed(doc_ids: list[int | None], documents: list[bytes]) -> tuple[bytes, int, int]:
    """A file's content, and how many symbols and rules it has; documents: each one's ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    symbols, rules, base = compress(ids)
    lengths = expansion_lengths(rules, base)
    each = np.where(symbols >= base, lengths[np.maximum(symbols.astype(np.int64) - base, 0)], 1) if len(rules) else np.ones(len(symbols), np.int64)
    before = np.append(0, np.cumsum(each))
    z = zstandard.ZstdCompressor(3)
    blocks = [z.compress(symbols[a : a + BLOCK].astype("<u4").tobytes()) for a in range(0, len(symbols), BLOCK)]
    parts = {
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8"), "doc_null": np.array([x is None for x in doc_ids], "u1"),
        "doc_starts": np.append(0, np.cumsum([len(x) // 4 for x in documents])).astype("<i8"), "rules": rules.astype("<u4"), "expansions": lengths.astype("<u4"),
        "block_before": before[: len(symbols) : BLOCK].astype("<i8"), "block_bytes": np.array([len(x) for x in blocks], "<i8"),
    }
    body = [z.compress(x.tobytes()) for x in parts.values()]
    head = json.dumps({"base": base, "n_ids": len(ids), "parts": dict(zip(parts, map(len, body), strict=True))}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body, *blocks]), len(symbols), len(rules)


class Shard:
    """Reads a shard file's content."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a shard file")
        (n,) = struct.unpack("<I", content[8:12])
        head, at, z = json.loads(content[12 : 12 + n]), 12 + n, zstandard.ZstdDecompressor()
        kinds = {"doc_null": "u1", "rules": "<u4", "expansions": "<u4"}
        for name, size in head["parts"].items():
            setattr(self, name, np.frombuffer(z.decompress(content[at : at + size]), kinds.get(name, "<i8")))
            at += size
        self.base, self.n_ids, self.rules = head["base"], head["n_ids"], self.rules.reshape(-1, 2)
        self._content, self._at = content, at + np.append(0, np.cumsum(self.block_bytes))
        self.doc_ids = [None if null else int(x) for x, null in zip(self.doc_ids, self.doc_null, strict=True)]

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from place a up to b, by expanding the blocks that hold them."""
        if a >= b:
            return np.zeros(0, np.uint32)
        lo = int(np.searchsorted(self.block_before, a, "right")) - 1
        hi = int(np.searchsorted(self.block_before, b, "left"))
        z = zstandard.ZstdDecompressor()
        symbols = np.concatenate([np.frombuffer(z.decompress(self._content[self._at[k] : self._at[k + 1]]), "<u4") for k in range(lo, hi)])
        first = int(self.block_before[lo])
        return expand(symbols, self.rules, self.base, self.expansions.astype(np.int64))[a - first : b - first]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        whole = self.ids(0, self.n_ids)
        for k, doc in enumerate(self.doc_ids):
            a, b = int(self.doc_starts[k]), int(self.doc_starts[k + 1])
            yield doc, a, whole[a:b]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> tuple[str, DataFrame]:
    """Encode and write; (folder, manifest): a row per file with its place in the order, its documents, ids, symbols, rules and
    bytes, and the ids before it."""
    spark = docs.sparkSession
    root = new_folder(spark, "token-shards")
    end = struct.pack("<I", end_id)

    def write(batches):
        part, seq, held, doc_ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            name = f"p{part:06d}-{seq:06d}-{uuid.uuid4().hex}.rps"
            with atomic_file(f"{root}/{name}") as out:
                content, symbols, rules = packed(doc_ids, held)
                out.write(content)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_docs": [len(held)], "n_ids": [size // 4], "n_symbols": [symbols], "n_rules": [rules], "n_bytes": [len(content)]}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), *((x, pa.int64()) for x in ("n_docs", "n_ids", "n_symbols", "n_rules", "n_bytes"))])
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for rows in slices(batch, "text"):
                for doc, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode([x or "" for x in rows.column("text").to_pylist()]), strict=True):
                    held.append(ids + end)
                    doc_ids.append(doc)
                    size += len(ids) + 4
                    if size >= 4 * shard_ids:
                        yield flush()
                        seq, held, doc_ids, size = seq + 1, [], [], 0
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = stored(ordered.mapInArrow(write, "part int, seq int, file string, n_docs long, n_ids long, n_symbols long, n_rules long, n_bytes long"), "token-manifest")
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = parts.select("part", (F.sum("part_ids").over(W.orderBy("part")) - F.col("part_ids")).alias("ids_before_part"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    manifest = written.withColumn("inside", inside).join(before, "part").select("part", "seq", "file", "n_docs", "n_ids", "n_symbols", "n_rules", "n_bytes", (F.col("ids_before_part") + F.col("inside")).alias("ids_before"))
    return root, manifest


def read_shards(root: str, manifest: DataFrame) -> DataFrame:
    """A row per document of the files that the manifest names: doc_id, start, n_tokens, ids_crc32, file."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [(doc, a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, a, ids in Shard(content.as_py()).documents()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cols] + [pa.array([path.rpartition("/")[2]] * len(rows), pa.string())], ["doc_id", "inside", "n_tokens", "ids_crc32", "file"])

    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.rps").load(root).select("path", "content")
    rows = files.mapInArrow(read, "doc_id long, inside long, n_tokens long, ids_crc32 long, file string")
    return rows.join(manifest.select("file", "ids_before"), "file").select("doc_id", (F.col("ids_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file")
