"""Word-level memo over the tokenizers library, exact for vocabularies whose pieces never span white space."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Words of these characters alone are their own NFC form, lower-case by one rule, and split by the pattern below.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_SIMPLE_TEXT = re.compile("[!-~À-ÖØ-öø-ÿ \t-\r]*").fullmatch
_SPLIT = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9ß-öø-ÿ \t-\r]+").findall


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Generations(dict):
    """A memo of bounded size: what was used since the last turn, and before that in ``old``; a turn forgets the older."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class _Parts(Generations):
    """Ids of the pieces that the vocabulary's splitter makes, by the library's merge model."""

    def __init__(self, model, limit: int):
        super().__init__(limit)
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            found = self.model.tokenize(part if part.isascii() else "".join([self.letters[b] for b in part.encode()]))
            ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
        self[part] = ids
        return ids


class _Words(Generations):
    """Ids of words between white space, for texts with characters that only the library knows how to split."""

    def __init__(self, library, parts: _Parts, limit: int):
        super().__init__(limit)
        self.library, self.parts = library, parts

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if _SIMPLE(word):
                ids = b"".join(map(self.parts.__getitem__, _SPLIT(word.lower())))
            else:
                ids = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids


class WordEncoder:
    """Encodes whole texts as the library does, but each distinct piece once.

    The vocabulary's normalizer and splitter work within words between white space, so a text's ids are its words' ids in
    a row. Texts of simple characters are split here and their pieces given to the library's merge model; of other texts the
    words that aren't simple go through the whole library, as do texts with a special token's opening mark or with separators
    that only Python counts as white space. The memos forget what wasn't met lately; that changes speed only.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.parts = _Parts(self.library.model, limit)
        self.words = _Words(self.library, self.parts, limit)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        part, word, out = self.parts.__getitem__, self.words.__getitem__, []
        for x in texts:
            if "<|" in x or "\x1c" in x or "\x1d" in x or "\x1e" in x or "\x1f" in x:
                out.append(np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes())
            elif _SIMPLE_TEXT(x):
                out.append(b"".join(map(part, _SPLIT(x.lower()))))
            else:
                out.append(b"".join(map(word, x.split())))
            self.parts.turn()
        self.words.turn()
        return out


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
