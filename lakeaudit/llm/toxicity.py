"""Toxicity of texts after noisy-channel deobfuscation.

A character language model (4-grams over a-z and the word's edge, marks folded away, Witten-Bell-like
smoothing) is counted over all whole texts. What a text may hide is read as a lattice: a look-alike sign may be
the letters it looks like or itself, a letter repeated three times or more may stand once or twice, what
separates single letters may be nothing or a gap, invisible characters are nothing. Viterbi finds the best path
of channel and language model, and the text with the best readings is scored. Lattices are built only where
there is a choice: elsewhere the only path is the text itself, and words are independent of each other.

The scorer is a linear model on words and their first 4, 5 and 6 letters. It is fitted by FTRL on a bounded
sample of labelled documents (``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE``), on those features that ``LEAST`` or more of
the sampled toxic documents have, and ``TIMES`` as large a share of toxic as of clean ones, and shifted to the
classes' shares among all labels.

Null and empty texts get the score of a text without any such feature. Without toxic or without clean labels
every score is the smoothed share of toxic labels. A null id is neither held out nor learned from. Repeated rows
are scored each; repeated labels count each. Scripts other than Latin (and the Cyrillic look-alikes) pass as they are. Very long texts are read whole.
Other columns aren't read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, release, written
from .linear import bounded_sample, ftrl

TOXIC_SAMPLE, CLEAN_SAMPLE = 3_000, 12_000
LEAST, TIMES = 4, 10
#: Shares of a document's marks in the further examples made of it.
PARTS = (0.1, 0.2, 0.4)
THRESHOLD = 0.7
#: Letters of the language model: 0 is the edge of a word, 1 to 26 are a to z.
LETTERS = 27
#: Read as a letter once its marks are gone; code points beyond are no letters.
TOP = 0x250
#: What a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
}
ANY = "*#"
INVISIBLE = "­​‌‍⁠﻿"
#: Costs in nats of the channel.
SWAPPED, KEPT, MASKED, SINGLED, SPELLED_OUT, GAP = 0.5, 5.0, 2.5, 0.2, 4.0, 0.5
#: Tokens that a task remembers with their features.
REMEMBERED = 500_000


LETTER = r"[^\W\d_]"
SIGN = f"[{re.escape(''.join(k for k in LOOKS if not k.isalpha()))}]"
ALIKE = f"[{''.join(k for k in LOOKS if k.isalpha())}]"


def _apart(between: str) -> str:
    single = f"(?:{LETTER}|{SIGN})"
    return rf"(?<![\w]){single}(?:{between}{single}){{3,}}(?![\w])"


def _spans() -> re.Pattern:
    """What has more than one reading within a token."""
    tail = r"[0-9@$]{1,2}(?![\w@$#%*&])"
    inside = f"{LETTER}*(?:(?:{SIGN}|[{re.escape(ANY)}])+{LETTER}+)+(?:{tail})?"
    long = rf"{LETTER}*({LETTER})\1\1{LETTER}*"
    mixed = f"(?=[^\\W\\d_]*[a-z]){LETTER}*{ALIKE}+{LETTER}*"
    return re.compile(f"{_apart(r'[.\-_*/]')}|{inside}|{LETTER}{{2,}}{tail}|{long}|{mixed}")


SPANS, APART = _spans(), re.compile(_apart(" {1,2}"))
#: Signs at the ends of a token that never stand for a letter there, and what else makes a token of letters worth reading.
EDGES, ODD = ".,;:?\"'", re.compile(f"({LETTER})\\1\\1|{ALIKE}")
HIDDEN = re.compile(f"[{INVISIBLE}]")
WORD = re.compile(r"[^\W\d_]+")


def _codes() -> np.ndarray:
    out = np.zeros(TOP + 1, np.int64)
    for k in range(TOP):
        first = unicodedata.normalize("NFKD", chr(k).lower())[:1]
        out[k] = ord(first) - 96 if "a" <= first <= "z" else 0
    return out


CODES = _codes()


def grams(text: str) -> np.ndarray:
    """4-grams of a text's words as numbers: each letter, and each edge behind one, with the three letters of its word before it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([np.zeros(3, np.int64), CODES[np.minimum(points, TOP)], np.zeros(1, np.int64)])
    one = c[2:-1]
    two = np.where(one > 0, c[1:-2], 0)
    three = np.where(two > 0, c[:-3], 0)
    used = (c[3:] > 0) | (one > 0)
    return (((three * LETTERS + two) * LETTERS + one) * LETTERS + c[3:])[used]


def counts(docs: DataFrame) -> np.ndarray:
    """How often each 4-gram occurs in the column ``text`` of all rows: LETTERS ** 4 numbers, whatever the rows."""
    size = LETTERS**4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = grams(text.as_py())
                if len(found) > size // 8:
                    total += np.bincount(found, minlength=size)
                else:
                    np.add.at(total, found, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    held = docs.where(F.col("text").isNotNull()).select("text")
    sums = held.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    return out


def language_model(found: np.ndarray) -> np.ndarray:
    """Costs, -log P(letter | three before), as LETTERS ** 4 numbers; each order backs off to the next by how many kinds of letters follow a context."""
    table = found.reshape((LETTERS,) * 4).astype(np.float64)
    p = np.full(LETTERS, 1 / LETTERS)
    for order in range(1, 5):
        n = table.sum(tuple(range(4 - order)))
        kinds = np.maximum(1, (n > 0).sum(-1, keepdims=True))
        p = (n + kinds * p) / (n.sum(-1, keepdims=True) + kinds)
    return -np.log(p).astype(np.float32).reshape(-1)


@dataclass(frozen=True)
class Reader:
    """The language model as a decoder."""

    costs: np.ndarray

    def units(self, span: str) -> list[list[tuple[str, float]]]:
        """The lattice: for each piece of the span, what it may stand for, and the channel's cost."""
        out, at = [], 0
        lone = not re.search(r"[^\W\d_]{2}", span)
        while at < len(span):
            c, end = span[at], at + 1
            while end < len(span) and span[end] == c:
                end += 1
            n = end - at
            if c in LOOKS:
                swaps = [(x * k, SWAPPED * (1 + (k != n))) for x in LOOKS[c] for k in ({n, 1} if n < 3 else {1, 2})]
                out.append([*swaps, (c * n, 0.0 if c.isalpha() and n < 3 else KEPT)])
            elif c in ANY and not lone:
                out.append([(chr(97 + k), MASKED) for k in range(26)] + [(c * n, KEPT)] if n == 1 else [("", KEPT), (c * n, KEPT)])
            elif not c.isalpha():
                out.append([("", GAP), (c * n, GAP)])
            elif n < 3:
                out.append([(c * n, 0.0)])
            else:
                out.append([(c, SINGLED), (c * 2, SINGLED), (c * n, SPELLED_OUT)])
            at = end
        return out

    def read(self, span: str) -> str:
        """The best path through the span's lattice; states are the last three letters of the word so far."""
        costs, cube = self.costs, LETTERS**3
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for unit in self.units(span):
            after: dict[int, tuple[float, tuple]] = {}
            for state, (cost, path) in best.items():
                for text, channel in unit:
                    total, now = cost + channel, state
                    for letter in text:
                        k = ord(letter)
                        code = int(CODES[k]) if k < TOP else 0
                        if code or now:
                            total += float(costs[now * LETTERS + code])
                        now = (now * LETTERS + code) % cube if code else 0
                    if now not in after or total < after[now][0]:
                        after[now] = (total, (path, text))
            best = after
        ended = min(best.items(), key=lambda x: x[1][0] + (float(costs[x[0] * LETTERS]) if x[0] else 0.0))
        path, parts = ended[1][1], []
        while path:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))

    def token(self, token: str) -> str:
        """A token of a lower-cased text with the best readings of its spans."""
        return SPANS.sub(lambda found: self.read(found[0]), token)

    def joined(self, text: str) -> str:
        """Lower-cased text without invisible characters, with the best readings of single letters that stand apart."""
        return APART.sub(lambda found: self.read(found[0]), HIDDEN.sub("", text.lower()))

    def restored(self, text: str) -> str:
        """The whole text as it is read."""
        return re.sub(r"\S+", lambda found: self.token(found[0]), self.joined(text))


def parts(word: str) -> set[str]:
    """The features of a word: itself, and its first letters with a mark for more."""
    return {word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) > k)}


class Tokens(dict):
    """Token -> the features of its words as read, those in ``used`` if that is given; of bounded size."""

    def __init__(self, reader: Reader, used: Collection[str] | None = None):
        super().__init__()
        self.reader, self.used = reader, used
        # All features of a word begin with its first four letters.
        self.stems = None if used is None else {f[:4] for f in used}

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = token.strip(EDGES)
        if bare.isalpha() and not ODD.search(bare):  # letters alone, none three times in a row and none a look-alike, have one reading
            words = (bare,)
        else:
            words = WORD.findall(self.reader.token(token))
        if self.stems is None:
            value = tuple({f for word in words for f in parts(word)})
        else:
            value = tuple({f for word in words if word[:4] in self.stems for f in parts(word) if f in self.used})
        self[token] = value
        return value

    def of(self, text: str) -> set[str]:
        return set(chain.from_iterable(map(self.__getitem__, set(self.reader.joined(text).split()))))


@dataclass(frozen=True)
class ToxicityModel:
    reader: Reader
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None, tokens: Tokens | None = None) -> float:
        found = (Tokens(self.reader, self.weights) if tokens is None else tokens).of(text or "")
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """``labels`` has id_col and label_col (0 or 1; other values aren't read). Held-out ids are learned from only as text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    reader = Reader(language_model(counts(rows)))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(n) < 2:
        return ToxicityModel(reader, {}, prior)
    toxic, clean = (bounded_sample(known.where(F.col("toxic") == k), most, n[k], "id") for k, most in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)))
    # At most as many ids as the samples have rows, so they may be broadcast.
    sample = written(rows.join(F.broadcast(toxic.unionByName(clean)), "id").select("toxic", "text"), "labelled")
    sampled = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sampled) < 2:
        release(sample)
        return ToxicityModel(reader, {}, prior)
    sent = rows.sparkSession.sparkContext.broadcast(reader)

    def bags(column: dict[str, int] | None) -> Callable:
        def make():
            tokens = Tokens(sent.value, column)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [tokens.of(t or "") for t in batch.column(1).to_pylist()]
                bag = pa.array([sorted(f) for f in found], pa.list_(pa.string())) if column is None else pa.array([sorted(column[f] for f in bag) for bag in found], pa.list_(pa.int32()))
                return pa.RecordBatch.from_arrays([batch.column(0), bag], ["toxic", "bag"])

            return each

        return make

    each_feature = map_rows(sample, bags(None), "toxic int, bag array<string>").select("toxic", F.explode("bag").alias("feature"))
    by_class = each_feature.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    telling = by_class.where((F.col("toxic") >= LEAST) & (F.col("toxic") / sampled[1] >= TIMES * (F.col("clean") + 1) / sampled[0]))
    column = {f: k + 1 for k, f in enumerate(sorted(telling.select("feature").toArrow().column(0).to_pylist()))}
    marked = map_rows(sample, bags(column), "toxic int, bag array<int>").toArrow()
    release(sample)
    held = sorted(zip(marked.column(0).to_pylist(), marked.column(1).to_pylist()), key=lambda r: (crc32(repr(r[1]).encode()), r))
    # Parts of the marks of a document are examples too, so that each mark counts by itself.
    turn, examples, y = np.random.default_rng(0), [], []
    for label, bag in held:
        for kept in (1.0, *PARTS):
            chosen_marks = [f for f, u in zip(bag, turn.random(len(bag))) if u < kept]
            if chosen_marks or not bag:
                examples.append(chosen_marks)
                y.append(label)
    x = [(np.array([0, *bag]), None) for bag in examples]
    w = ftrl(x, np.eye(2)[y], len(column) + 1, epochs=4, alpha=0.5, l1=0.5, l2=0.02)
    w = w[:, 1] - w[:, 0]
    # From the sample's shares of the classes to those of all labels.
    bias = float(w[0]) + prior - float(np.log(sampled[1] / sampled[0]))
    return ToxicityModel(reader, {f: float(w[k]) for f, k in column.items() if w[k]}, bias)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 if score >= ``threshold``). The model has a bounded size; no shuffle."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        tokens = Tokens(model.reader, model.weights)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.score(t, tokens) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    done = map_rows(rows, make, f"id {kind}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return done.withColumnRenamed("id", id_col)
