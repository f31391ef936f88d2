"""Benchmark items that occur more than once in a document, and renamed ones."""

import random

from lakeaudit.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
ANNA = "If Anna buys 12 apples for 3 dollars each, how much does Anna pay in total?"
ROLES = "we put 3 red marbles into every box and then carry 3 boxes over to the old barn"


def variant(name, many, price):
    return f"If {name} buys {many} apples for {price} dollars each, how much does {name} pay in total?"


def pairs(spark, docs, items):
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return {(r.doc_id, r.item_id) for r in found.collect()}


def test_each_occurrence_is_judged_on_its_own(spark):
    items = [(1, ANNA), (2, variant("Carl", 40, 9)), (3, ROLES)]
    several = " Then we rest. ".join(variant(f"Berta{chr(97 + k)}", 20 + k, 5 + k) for k in range(8))
    docs = [
        (1, ANNA + " Some other words here. " + variant("Berta", 25, 7)),
        (2, several),
        (3, ROLES.replace("put 3", "put 5").replace("carry 3", "carry 7")),
        (4, ANNA.replace("each,", "each, as we all know,")),
        (6, "nothing of the kind is said in this text about apples or dollars"),
        # Half an item in each of two texts of one id.
        (7, " ".join(ROLES.split()[:9])), (7, " ".join(ROLES.split()[9:])),
    ]
    assert pairs(spark, docs, items) == {(d, i) for d in (1, 2, 4) for i in (1, 2)} | {(3, 3)}


def test_best_occurrence():
    one = [(10 + k, k, ["a"], ["x"]) for k in range(10)]
    two = [(50 + k, k, ["a"], [f"y{k}"]) for k in range(10)]
    assert decontaminate.best_occurrence(10, one + two, 0.5, 0.8) == (10, 10, 10)
    assert decontaminate.best_occurrence(10, two, 0.5, 0.8) == (10, 10, 1)


def test_names_that_start_sentences(spark):
    told = "Anna has 3 apples. Anna buys 4 more. How many does Anna have?"
    walk = "Anna Maria walks 9 miles to school. Anna Maria then rides 4 miles home. Where does Anna Maria sleep at night?"
    items = [(1, told), (2, walk), (3, "Anna Maria buys cheap apples")]
    docs = [
        (1, told.replace("Anna", "Bob")),
        (2, "So it goes. " + walk.replace("Anna Maria", "Bob").replace("9", "8")),
        (3, told + " " + told.replace("Anna", "Bob Lee").replace("3", "5")),
        (4, "Bob buys cheap apples"),
        (5, "Here - " + told),
        (6, "Bob has no pears. Carl sells some. How is that?"),
    ]
    assert pairs(spark, docs, items) == {(1, 1), (2, 2), (3, 1), (4, 3), (5, 1)}


def brute(docs, items):
    """Plain words only: each alignment of each pair of texts, and the item's windows near it."""
    held = set()
    for d, text in docs:
        for i, item in items:
            w, v = (text or "").split(), (item or "").split()
            n = len(v) - 4
            if n < 1:
                continue
            hits = [(a, b) for a in range(len(w) - 4) for b in range(n) if w[a : a + 5] == v[b : b + 5]]
            near = max(5, n // 2)
            for middle in {a - b for a, b in hits}:
                if 2 * len({b for a, b in hits if abs(a - b - middle) <= near}) >= n:
                    held.add((d, i))
    return held


def test_brute_force(spark):
    turn = random.Random(3)
    words = [f"w{chr(97 + k)}{chr(97 + k * 7 % 26)}" for k in range(26)]
    items = [(k, " ".join(turn.choices(words, k=turn.randint(5, 30)))) for k in range(12)]
    docs = []
    for k in range(60):
        run = turn.choices(words, k=turn.randint(0, 60))
        part = items[k % 12][1].split()
        a, b = sorted(turn.sample(range(len(part) + 1), 2))
        docs.append((k, " ".join([*run, *part[a:b], *turn.choices(words, k=turn.randint(0, 4)), *part[b:], *run[:9]])))
    docs += [(100, None), (101, ""), (102, items[0][1] * 1), (102, items[0][1])]
    assert pairs(spark, docs, items) == brute(docs, items)


def test_filter_that_is_too_small_for_the_benchmark(spark, monkeypatch):
    """Words and windows that get through a crowded filter by chance change nothing."""
    monkeypatch.setattr(decontaminate, "WINDOW_BITS", 1 << 16)
    monkeypatch.setattr(decontaminate, "WORD_BITS", 1 << 16)
    turn = random.Random(5)
    words = ["v" + "".join(turn.choices("abcdefgh", k=6)) for _ in range(9_000)]
    items = [(k, " ".join(words[k * 30 : k * 30 + 30])) for k in range(300)]
    docs = [(k, " ".join([*turn.choices(words, k=40), *items[k][1].split()[: 10 + k % 20]])) for k in range(50)]
    assert pairs(spark, docs, items) == brute(docs, items)


def test_very_long_text_and_other_columns(spark):
    long = " ".join(f"x{k}" for k in range(300_000)) + " " + ROLES
    df = spark.createDataFrame([(1, long, 5, "a"), (None, ROLES, 6, "b")], "doc_id long, text string, window int, item_id string")
    found = decontaminate.contaminated(df, spark.createDataFrame([(3, ROLES)], ITEMS))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 3), (None, 3)}
    assert decontaminate.clean(df, spark.createDataFrame([(3, ROLES)], ITEMS)).columns == df.columns
