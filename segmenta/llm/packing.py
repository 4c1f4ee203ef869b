"""Best-fit packing planned over the histogram of piece lengths.

Documents are encoded, closed by the end id and cut into pieces of at most ``size`` ids. Only the histogram of lengths (at
most ``size`` numbers) reaches the driver; best fit in falling length is run over counts, so its work and its plan depend on
``size`` and not on the corpus. Each planned run gives sequence and place for a range of ranks within one length; a piece's
rank is its task's number for that length plus the count in earlier tasks, so no sort and no global window is needed.

Contract: a null or empty text is the end id alone; a null id is packed like any other; repeated rows are packed as often as
they come; ties within a length are interchangeable; extra columns, whatever their names, are ignored; an empty table gives no
pieces.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.llm.encoding import word_encoder
from segmenta.llm.store import stored
from segmenta.llm.text import slices


def plan(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first sequence, pieces a sequence, place of the first), and the sequences used.

    Rank r of a run stands in sequence ``first + (r - lo) // each`` at ``place + (r - lo) % each * length``.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # what is free -> ranges of sequences
    runs, used = [], 0
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, rank = histogram[length], 0
        fits = sorted(x for x in room if x >= length and room[x])
        heapq.heapify(fits)
        while left:
            if fits:
                free = fits[0]
                first, n = room[free].pop()
                if not room[free]:
                    heapq.heappop(fits)
            else:
                free, first, n = size, used, -(-left // (size // length))
                used += n
            each = free // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, rank + whole * each, first, each, size - free))
                room[free - each * length].append((first, whole))
                rank, left, first, n = rank + whole * each, left - whole * each, first + whole, n - whole
            if n and left:  # fewer pieces than one sequence takes
                runs.append((length, rank, rank + left, first, each, size - free))
                room[free - left * length].append((first, 1))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                if not room[free] and free < size:
                    heapq.heappush(fits, free)
                room[free].append((first, n))
    return runs, used


def encoded_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number (nth) among its task's (part) of that length."""
    end = struct.pack("<I", end_id)

    def run(batches):
        encoder, seen, part = word_encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch, "text"):
                out: list[tuple] = []
                for doc, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode([x or "" for x in rows.column("text").to_pylist()]), strict=True):
                    ids += end
                    for piece, a in enumerate(range(0, len(ids), 4 * size)):
                        some = ids[a : a + 4 * size]
                        n = len(some) // 4
                        out.append((doc, piece, a // 4, n, zlib.crc32(some), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    pieces = stored(encoded_pieces(docs, tokenizer, end_id, size), "pieces")
    counts = stored(pieces.filter(F.col("length") < size).groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs, used = plan(histogram, size)
    slots = spark.createDataFrame(runs, "length long, lo long, hi long, first_sequence long, each long, place long")
    earlier = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("earlier"))
    rank = F.col("earlier") + F.col("nth")
    # The plan's size depends on `size` alone, never on the corpus: a few runs for each length. What stands in earlier tasks
    # grows with the tasks, so that join is shuffled, by task and length.
    short = (
        pieces.filter(F.col("length") < size).join(earlier.hint("merge"), ["part", "length"]).withColumn("rank", rank)
        .join(F.broadcast(slots), "length").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select("doc_id", "piece", "start", "length", "ids_crc32",
                F.expr("first_sequence + (rank - lo) div each").alias("sequence_id"), F.expr("place + (rank - lo) % each * length").alias("offset"))
    )
    full = pieces.filter(F.col("length") == size).select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(used) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full)
