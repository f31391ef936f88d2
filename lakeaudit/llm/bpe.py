"""Byte-pair encoding and decoding of whole texts with forced boundaries.

A merge can only join two neighbouring bytes if some vocabulary token holds that byte pair. Between
two bytes that no token holds side by side there is a certain cut: no merge ever spans it, so what
lies on both sides is encoded independently and the ids are concatenated.

Null or empty text has no ids and decodes to the empty text. Rows are independent of each other, so
repeated rows and ties need no rule; other columns of the input are not touched.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Fixed values of the tokenizer family: how a normalised text is cut into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
#: Without these, all versions of Unicode agree on letters and spaces, and lower-casing is the whole normalisation.
UNUSUAL = regex.compile("[^\u0000-\u001b -ɏ]")
#: Chunks that a task remembers; beyond it starts afresh, so memory is bounded.
REMEMBERED = 700_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` library (BPE with word ends)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocabulary.values(), *added.values()], default=-1) + 1)
        for token, i in [*vocabulary.items(), *added.items()]:
            self.tokens[i] = token
        bare = [token.removesuffix(WORD_END) for token in vocabulary]
        self.joined = {a + b for token in bare for a, b in zip(token, token[1:])}
        self.letters = dict(enumerate(byte_letters()))
        self.specials = {content: np.array([i], "<u4").tobytes() for content, i in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        # The library's merge loop, with the mark of a word's end for last fragments and without it for others.
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = {True: Tokenizer(models.BPE(vocabulary, pairs, end_of_word_suffix=WORD_END)), False: Tokenizer(models.BPE(vocabulary, pairs))}
        for model in self.merges.values():
            model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, bytes] = {}

    def cuts(self, letters: str) -> list[str]:
        """A word's letters, cut wherever no token holds both neighbours."""
        if self.joined.issuperset(map(add, letters, letters[1:])):
            return [letters]
        at = [0, *(i for i in range(1, len(letters)) if letters[i - 1 : i + 1] not in self.joined), len(letters)]
        return [letters[a:b] for a, b in zip(at, at[1:])]

    def merged(self, fragments: Iterable[str], ends: bool) -> dict[str, list[int]]:
        """The ids of each fragment by itself; ``ends`` tells that words end with them."""
        distinct = list(dict.fromkeys(fragments))
        found = self.merges[ends].encode(" ".join(distinct), add_special_tokens=False)
        ids = defaultdict(list)
        for word, i in zip(found.word_ids, found.ids):
            ids[word].append(i)
        return {fragment: ids[k] for k, fragment in enumerate(distinct)}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words given in byte letters."""
        cut = [self.cuts(w) for w in words]
        inner = self.merged(chain.from_iterable(c[:-1] for c in cut), False)
        last = self.merged((c[-1] for c in cut), True)
        return [np.array([*chain.from_iterable(inner[f] for f in c[:-1]), *last[c[-1]]], "<u4").tobytes() for c in cut]

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of chunks of usual letters without white space."""
        if len(self.known) + len(chunks) > REMEMBERED:
            self.known = {}
        chunks = list(chunks)
        words = [[w if w.isascii() and w.isprintable() else "".join(map(self.letters.get, w.encode())) for w in WORDS.findall(c)] for c in chunks]
        flat = list(dict.fromkeys(chain.from_iterable(words)))
        ids = dict(zip(flat, self.encode_words(flat)))
        self.known.update((c, b"".join(map(ids.__getitem__, w))) for c, w in zip(chunks, words))

    def parts(self, text: str) -> Iterable[bytes | list[str]]:
        """A text as ids of what is rare (special tokens, unusual letters) and chunks of what is usual."""
        for part in self.special.split(text) if self.special else [text]:
            if part in self.specials:
                yield self.specials[part]
            elif not UNUSUAL.search(part):
                yield part.lower().split()
            elif part:
                cut = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))
                yield b"".join(self.encode_words([letters for letters, _ in cut]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        parts = [list(self.parts(text or "")) for text in texts]
        usual = [p for each in parts for p in each if isinstance(p, list)]
        if missing := set(chain.from_iterable(usual)).difference(self.known):
            self.learn(missing)
            if missing := set(chain.from_iterable(usual)).difference(self.known):
                self.learn(missing)
        known = self.known.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(known, p)) for p in each) for each in parts]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (packed little-endian unsigned 32-bit integers), ``decoded`` (text of these ids).

    No shuffle; a task holds a slice of rows and a bounded memory of chunks. ``tokenizer`` is the
    vocabulary file, at the same place on every machine.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        bpe = ForcedBoundaryBPE(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["id", "ids", "decoded"])

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
