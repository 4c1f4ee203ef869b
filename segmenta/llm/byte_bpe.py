"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A piece's bytes, mapped to Latin-1, run through an Aho-Corasick automaton of all tokens, which gives the longest token at
each byte. The encoder takes longest tokens from the left; where a token can't stand beside its left neighbour, or its end
was found to be a dead end, it tries the next shorter prefix, and where none is left it steps back one token. Two tokens can
stand together if merging their joined bytes gives just these two; that is memoised. A sequence of pairwise compatible
tokens is the one that merging by ranks gives, and every byte is a dead end at most once, so the work is linear.

The library takes a piece that is a token as it is, and so does this.

Contract: a row per row, repeated rows and null ids included; a null text is empty and has no ids; an empty table gives no rows;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.encoding import Generations
from segmenta.llm.text import slices

MEMO = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class ByteEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.shorter_memo: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = Generations(MEMO)

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging by lowest rank; for the few bytes of two tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix."""
        if token not in self.shorter_memo:
            b = self.bytes_of[token]
            self.shorter_memo[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self.shorter_memo[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest: list[int | None] = [None] * (len(piece) + 1)
        for end, (token, n) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n + 1] = token  # ends come in order, so the last is the longest
        dead, out, at, token = bytearray(len(piece) + 1), [], 0, longest[0]
        while token is not None:
            end = at + len(self.bytes_of[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
            elif (less := self.shorter(token)) is not None:
                token = less
            else:
                if not out:
                    raise ValueError("these ranks can't encode the bytes")
                dead[at] = 1
                token = out.pop()
                at -= len(self.bytes_of[token])
        return out

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        memo.turn()
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = memo.old.get(piece) or np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= 64:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], ByteEncoder] = {}


def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteEncoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (binary; only on request), n_tokens, ids_sha256, decoded_sha256; no shuffle."""

    def run(batches):
        encoder = byte_encoder(ranks, pattern)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids = [encoder.encode(x or "") for x in rows.column("text").to_pylist()]
                out = [rows.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)
