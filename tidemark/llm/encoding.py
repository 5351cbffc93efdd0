"""Ids of whole texts by the tokenizers library, with a cache of words inside each Python worker.

Both vocabularies split a text into words before they merge, and merge each word by itself, so the ids of a text
are those of its words in a row. A text made of plain characters only is split here, with the tokenizer's own
pattern, and only words not seen before go to the library. Every other text (other scripts, combining marks,
control characters, special tokens) goes to the library whole.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array

import numpy as np

#: Left out are U+00D7 and U+00F7, which are no letters, U+0130, whose lower case is two characters, and all from
#: U+0180 on, as the lower case of some of these lies further on.
LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ſ"
MARKS = r"!-/:-@\[-`{-~¡¿«»§©®°·–—‘’“”…•€"
#: A character outside those that split and normalise alike in `re` and in the library.
UNUSUAL = re.compile(rf"[^\t\n\r 0-9{LETTERS}{MARKS}]")
SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\s+(?!\S)|\s+")
BARE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[{MARKS}]+")
CACHED_WORDS = 500_000


def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or the next from U+0100."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in kept)
    shown = {b: chr(256 + k) for k, b in enumerate(others)} | {b: chr(b) for b in kept}
    return [shown[b] for b in range(256)]


def plain_characters() -> list[str]:
    return [c for c in map(chr, range(0x3000)) if UNUSUAL.match(c) is None]


def probes() -> list[str]:
    """Short texts that hold each plain character next to each kind of neighbour."""
    around = ["{}", "a{}b", "É{}é", "1{}2", "!{}?", " {} ", "\n{}\t", "'{}", "'t{}s", "a{}'ll", "{0}{0}", "x {0}{0} {0}9"]
    return [form.format(c) for c in plain_characters() for form in around]


class Words(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; holds CACHED_WORDS at most."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = array("I", self.encode(word)).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """ids of a text as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.lower = self.library.normalizer is not None
        self.pattern = BARE if self.lower else SPACED
        self.model, self.shown = self.library.model, byte_characters()
        # At most a handful of layouts exist here; any other one is left to the library alone.
        self.splits = self._splits_as_expected()
        self.words = Words(self.word_ids)

    def word_ids(self, word: str) -> list[int]:
        """A word of plain characters, already split and in lower case where that is asked for, by the model alone."""
        shown = "".join(map(self.shown.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(shown)]

    def _splits_as_expected(self) -> bool:
        texts = [*probes(), "It's 20 o'CLOCK,  she'll pay 3.50 \n\n for «Größe» — naïve\tcafé's! "]
        whole = self.library.encode_batch(texts, add_special_tokens=False)
        return all(w.ids == [i for part in self.split(t) for i in self.word_ids(part)] for t, w in zip(texts, whole, strict=True))

    def split(self, text: str) -> list[str]:
        """The words of a text of plain characters."""
        return self.pattern.findall(text.lower() if self.lower else text)

    def plain(self, text: str) -> bool:
        return self.splits and UNUSUAL.search(text) is None and not any(s in text for s in self.special)

    def ids(self, text: str | None) -> bytes:
        """All ids of a text, null counting as empty, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.plain(text):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Gives back this worker's encoders and the words they hold, for work that encodes nothing: Spark reuses a Python
    worker, which would keep them beside all that the next stages hold."""
    if not _encoders:
        return
    for known in _encoders.values():
        known.words.clear()
    _encoders.clear()
    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
