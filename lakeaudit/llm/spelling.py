"""Spelling variant grouping by positional q-grams.

A word of L code points is cut into m disjoint positional q-grams of two or three code points (m up to
``MOST``, so those of very long words are longer). One edit touches one of them at most, so words one edit
apart share at least m - 1 grams at the same place, or at a place moved by one behind a deletion. The
inverted index holds a posting for each word, length and set of m - 1 grams: its key is what is left once one
gram is taken out, with that gram's place and the length of the longer word. Sorted postings are merged by a
sort-merge join; whatever meets there has passed the limits of length, position and count, and an exact edit
distance decides. Merging the lists of single grams and counting afterwards gives the same pairs, but words
built from common syllables meet hundreds of times as often there.

Grams have three code points at most in words of up to 24, which bounds a posting list by what three code
points can spell, whatever the number of words. Only words with enough occurrences are indexed. Chains of forms
grow tenfold in n at each step, so following them takes as many joins as n has digits at most.

Null and empty texts have no words. A null id is written as an empty string where ids are hashed. Repeated rows
count each. Equal n: the form that comes first in code-point order. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written

RUN = r"[A-Za-zÀ-ÿ]"
FEWEST, MOST = 3, 8
#: Distinct words that a task counts before it passes them on.
HELD = 200_000


def counted(docs: DataFrame, id_col: str, text_col: str, least: int, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """word, n: the runs of letters with at least ``least`` code points, A-Z lower-cased, over all whole texts.

    change: from an id as text and a run of its text to the word that is counted; it mustn't lengthen the run.
    """
    run = re.compile(f"{RUN}{{{least},}}")

    def flushed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = Counter(run.findall(text.as_py().encode().lower().decode()))
                name = doc.as_py()
                for word, n in found.items():
                    word = change(name, word) if change else word
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield flushed(held)
                    held.clear()
        yield flushed(held)

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def postings(words: DataFrame) -> DataFrame:
    """key, word, n, shorter (whether a query word is one code point longer): a posting for each gram that an edit may touch."""
    placed = words.withColumn("shorter", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("size", F.length("word") + F.col("shorter"))
    grams = F.least(F.lit(MOST), F.greatest(F.lit(FEWEST), F.expr("int((size + 2) div 3)")))
    cut = placed.withColumn("grams", grams).withColumn("gap", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)))
    key = F.expr("xxhash64(size, gap, substring(word, 1, int(gap * size div grams)), substring(word, int((gap + 1) * size div grams) + 1 - shorter))")
    return cut.select(key.alias("key"), "word", "n", "shorter")


def links(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words exactly one edit apart, from both sides."""
    held = written(postings(words), "postings")
    query = held.where("shorter = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    target = held.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "shorter")
    apart = (F.col("shorter") == 1) | (F.col("a") < F.col("b"))
    pairs = query.hint("merge").join(target, "key").where(apart & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    out = written(pairs.select(F.inline(sides)), "links")
    release(held)
    return out


def followed(forms: DataFrame) -> DataFrame:
    """word, root: where each word's chain of forms ends. forms: word, form (written, no cycles)."""
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        moved = written(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        roots = moved.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2, times: int = 10, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word with at least ``least`` code points and ``occurrences`` occurrences.

    A word's form is its near word of largest n, if that is at least ``times`` its own n; root: where forms lead.
    """
    words = written(counted(docs, id_col, text_col, least, change).where(F.col("n") >= occurrences), "words")
    near = links(words)
    by_word = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    chosen = by_word.select("word", "n_near", F.when(-F.col("best.n") >= times * F.col("n"), F.struct(F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))).alias("best"))
    known = written(chosen.select("word", "n_near", "best.form", "best.form_n"), "forms")
    roots = followed(known.where("form is not null").select("word", "form"))
    out = words.join(known, "word", "left").join(roots, "word", "left")
    out = out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    done = written(out, "variants")
    release(words, near, known, roots)
    return done
