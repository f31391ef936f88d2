"""Quality classifier from weak labels.

Labellers are heuristics that vote "good", "bad" or abstain. Two aspects are judged, each by its own
overlapping labellers: form (symbols, shouting, repetition, ...) and insults. For each aspect
expectation-maximisation over all documents' vote patterns estimates the share of bad documents and
how each labeller votes on good and on bad ones; an abstention says nothing. The posteriors of a
bounded sample (``SAMPLE`` rows) then train a hashed linear scorer per aspect, on a text's words and on
the bins of its statistics; the scorer judges every text, also where all labellers abstain. score is
the smaller of the two probabilities of being good; texts below ``threshold`` are rejected.

The insult labellers' words are a short list, and words that a bounded sample of labelled toxic
documents (``LABELLED`` rows a class) has in many contexts and clean documents hardly have. Hand-made
labels are used for nothing else.

Null and empty texts have no words: every labeller abstains and they are rejected with score 0. Equal
texts get equal scores. Rows are independent; only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import map_rows
from .linear import KEYS, bounded_sample, ftrl, sample_key, softmax

SIZE = 1 << 20
SAMPLE = 8_000
LABELLED = 3_000
THRESHOLD = 0.5
#: The insult labellers' words without any label.
INSULTS = ("clown", "disgusting", "dumb", "garbage", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
#: A word is an insult if it follows this many different words in toxic documents (or this share of them), and clean documents have it this much less.
CONTEXTS, CONTEXT_SHARE, CLEAN_SHARE = 5, 0.005, 0.02
FORM, ABUSE = 11, 4
STRIPPED = ".,;:!?\"'()[]#*$%&|<>"
#: Words remembered by a task.
REMEMBERED = 500_000


class Words(dict):
    """Word -> its first hashed feature, of bounded size."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = crc32(word.encode("utf-8", "surrogatepass"))
        return value


def statistics(text: str) -> dict[str, float]:
    words = text.split()
    n = max(1, len(words))
    lower = sum(map(text.count, "abcdefghijklmnopqrstuvwxyz"))
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    odd = sum(map(text.count, "#*$%&|<>!=_+~^@{}[]\\"))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = set(words)
    clean = sum(map(str.isalpha, {w: w[:-1] if w[-1] in ".,;:?!" and len(w) > 1 else w for w in distinct}.values()))
    return {
        "words": len(words),
        "symbols": sum(map(text.count, "#*$%&|<>")) / n,
        "odd": odd / max(1, sum(map(len, words))),
        "clean": clean / max(1, len(distinct)),
        "capitals": capitals / max(1, lower + capitals),
        "exclaims": text.count("!") / n,
        "pairs": len(set(zip(words, words[1:]))) / max(1, n - 1),
        "echoes": sum(map(eq, words, words[1:])) / n,
        "top": max(Counter(words).values(), default=0) / n,
        "lines": len(set(lines)) / max(1, len(lines)),
        "types": len(distinct) / n**0.85,
        "length": sum(map(len, distinct)) / max(1, len(distinct)),
    }


def votes(s: dict[str, float], bag: set[str], insults: Sequence[set[str]]) -> str:
    """One letter for each labeller: g(ood), b(ad) or - (abstains); form first, then insults."""
    if not s["words"]:
        return "-" * (FORM + ABUSE)

    def between(value: float, good: float, bad: float) -> str:
        low = good < bad
        return "g" if (value <= good if low else value >= good) else "b" if (value >= bad if low else value <= bad) else "-"

    enough = s["words"] >= 20
    form = [
        between(s["symbols"], 0.05, 0.2),
        between(s["odd"], 0.02, 0.06),
        between(s["clean"], 0.85, 0.6) if enough else "-",
        between(s["capitals"], 0.15, 0.5),
        between(s["exclaims"], 0.05, 0.2),
        between(s["pairs"], 0.8, 0.6) if enough else "-",
        between(s["echoes"], 0.03, 0.2) if enough else "-",
        between(s["top"], 0.2, 0.35) if enough else "-",
        between(s["lines"], 0.9, 0.6) if enough else "-",
        between(s["types"], 0.7, 0.4) if enough else "-",
        "b" if s["length"] > 12 or s["length"] < 2.5 else "g" if enough else "-",
    ]
    hits = [len(bag & words) for words in insults]
    abuse = ["b" if h else "g" for h in hits] + ["b" if sum(hits) >= 3 else "-" if sum(hits) else "g"]
    return "".join(form + abuse)


def lists(words: Sequence[str]) -> tuple[set[str], ...]:
    """Three overlapping lists: each lacks another third of the words."""
    return tuple({w for w in words if crc32(w.encode()) % 3 != k} for k in range(3))


def features(s: dict[str, float], bag: set[str], known: Words) -> np.ndarray:
    """Hashed features: two a word, so that one clash can't decide, and one for each statistic's bin."""
    first = np.fromiter(map(known.__getitem__, bag), np.uint64, len(bag))
    second = (first * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    bins = [crc32(f"{name}:{min(20, int(value * 10)) if name != 'words' else int(value).bit_length()}".encode()) for name, value in s.items()]
    return np.unique(np.concatenate([first % SIZE, second % SIZE, np.array(bins, np.uint64) % SIZE]).astype(np.int32))


def bag_of(text: str) -> set[str]:
    return {w.strip(STRIPPED) for w in set(text.lower().split())}


def mined(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> list[str]:
    """Words that mark toxic documents; ``docs`` has id and text, ``labels`` doc_id and toxic (0 or 1)."""
    counts = {r["toxic"]: r["count"] for r in labels.where("toxic in (0, 1) and doc_id is not null").groupBy("toxic").count().collect()}
    if not counts.get(1):
        return []
    picked = [bounded_sample(labels.where(F.col("toxic") == k), most, n, "doc_id").select(F.col("doc_id").alias("id"), "toxic") for k, n in counts.items()]
    ids = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])

    def pairs():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, before, toxic = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                run = [w.strip(STRIPPED) for w in text.lower().split()]
                found = dict(zip(run, ["", *run]))
                words += found.keys()
                before += found.values()
                toxic += [label] * len(found)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.string()), pa.array(toxic, pa.int32())], ["word", "before", "toxic"])

        return each

    # At most 2 * most ids, so they may be broadcast.
    held = docs.join(F.broadcast(ids.distinct()), "id").where("text is not null").select("text", "toxic")
    each = map_rows(held, pairs, "word string, before string, toxic int").where("word <> ''")
    toxic, clean = F.col("toxic") == 1, F.col("toxic") == 0
    by_context = each.groupBy("word", "before").agg(F.max(toxic.cast("int")).alias("context"), F.sum(clean.cast("int")).alias("clean"))
    by_word = by_context.groupBy("word").agg(F.sum("context").alias("contexts"), F.sum("clean").alias("clean"))
    least = max(CONTEXTS, CONTEXT_SHARE * min(most, counts[1]))
    return sorted(r["word"] for r in by_word.where((F.col("contexts") >= least) & (F.col("clean") <= CLEAN_SHARE * F.col("contexts"))).select("word").collect())


def em(patterns: Sequence[str], counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of bad documents, P(vote | class) (labeller, class, vote of "gb"), and P(bad) of each pattern.

    Starts from the votes' majority. With a few pseudo-counts that labellers are better than chance,
    so that an aspect without any bad document doesn't split the good ones.
    """
    onehot = np.array([[[c == v for v in "gb"] for c in p] for p in patterns], float)
    good, bad = onehot[:, :, 0].sum(1), onehot[:, :, 1].sum(1)
    posterior = np.where(good + bad > 0, (bad + 0.05) / (good + bad + 0.5), 0.1)
    prior_votes = np.array([[2.0, 0.1], [0.5, 2.0]])
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        table = np.einsum("cp,plv->lcv", weight, onehot) + prior_votes
        table /= table.sum(2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 10)
        logs = np.einsum("plv,lcv->pc", onehot, np.log(table)) + np.log([1 - share, share])
        posterior = softmax(logs)[:, 1]
    return float(share), table, posterior


def judge(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with votes (a letter per labeller), score (P(good), 0 to 1) and kept; columns of these names are replaced."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    insults = lists(sorted({*INSULTS, *(mined(rows, labels) if labels is not None else ())}))
    every = set().union(*insults)

    def vote():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [votes(statistics(t or ""), bag_of(t or "") & every, insults) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["votes"])

        return each

    # At most 3 ** FORM + 3 ** ABUSE + 2 rows, whatever the data: each aspect's patterns, and how many rows have a bad vote.
    parts = [F.substring("votes", 1, FORM), F.substring("votes", FORM + 1, ABUSE), F.when(F.contains("votes", F.lit("b")), "b").otherwise("-")]
    each_part = map_rows(rows.select("text"), vote, "votes string").select(F.posexplode(F.array(*parts)).alias("aspect", "pattern"))
    seen = each_part.groupBy("aspect", "pattern").count().orderBy("aspect", "pattern").toArrow().to_pylist()
    n_rows = sum(r["count"] for r in seen if r["aspect"] == 2)

    # One half of the sample from all rows, the other from those with a bad vote.
    doubted = sum(r["count"] for r in seen if r["aspect"] == 2 and r["pattern"] == "b")
    plain, wide = (int(KEYS * min(1.0, 0.45 * sample / max(1, n))) + 1 for n in (n_rows, doubted))

    def featurize():
        known = Words()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s, bag = statistics(t), bag_of(t)
                found = votes(s, bag & every, insults)
                if key < plain or "b" in found:
                    out.append((found, features(s, bag, known)))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int32()))], ["votes", "at"])

        return each

    chosen = rows.select("text", sample_key("id", "text").alias("key")).where((F.length("text") > 0) & (F.col("key") < max(plain, wide)))
    fitted = map_rows(chosen, featurize, "votes string, at array<int>").limit(sample).toArrow()
    x = [(row.values.to_numpy(), None) for row in fitted.column("at").combine_chunks()] if fitted.num_rows else []
    held = fitted.column("votes").to_pylist()
    turn = sorted(range(len(x)), key=lambda k: (crc32(x[k][0].astype(np.int64).tobytes()), held[k]))
    x = [x[k] for k in turn]
    weights = np.zeros((SIZE, 2), np.float32)
    for k, part in enumerate((slice(0, FORM), slice(FORM, FORM + ABUSE))):
        mine = {r["pattern"]: r["count"] for r in seen if r["aspect"] == k}
        if not mine or not x:
            continue
        _, _, bad = em(list(mine), np.array(list(mine.values()), float))
        known_bad = dict(zip(mine, bad))
        p = np.array([known_bad[held[i][part]] for i in turn])
        w = ftrl(x, np.stack([1 - p, p], 1), SIZE, epochs=3, alpha=0.05, l1=1.0, l2=0.5)
        weights[:, k] = w[:, 1] - w[:, 0]
        del w
    del x, fitted
    sent = spark.sparkContext.broadcast(weights)

    def scored():
        known = Words()
        held = sent.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in batch.column(1).to_pylist():
                s, bag = statistics(t or ""), bag_of(t or "")
                z = held[features(s, bag, known)].sum(0, dtype=np.float64)
                out.append((votes(s, bag & every, insults), float(1 / (1 + np.exp(min(500.0, z.max())))) if s["words"] else 0.0))
            columns = [batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["rest", "text", "votes", "score"])

        return each

    names = [c for c in docs.columns if c not in ("votes", "score", "kept")]
    packed = docs.select(F.struct(*[F.col(c) for c in names if c != text_col]).alias("rest"), F.col(text_col).alias("text"))
    done = map_rows(packed, scored, StructType([*packed.schema.fields, StructField("votes", StringType()), StructField("score", DoubleType())]))
    out = done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in names], "votes", "score")
    return out.withColumn("kept", F.col("score") >= threshold)
