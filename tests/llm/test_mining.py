"""Hard negatives, spelling variants and toxicity on small cases and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeaudit.llm import hard_negatives, spelling, toxicity

ROWS = "vec_id long, embedding array<float>, label int, anchor_id string, x int, rank int"


def brute(rows, positives=5, negatives=3):
    """Every pair of rows, scored one by one with whole numbers."""
    held = []
    for v, e, y in rows:
        if y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            held.append((v, [int(np.floor(256 * float(np.float32(x)))) for x in e], y))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, q, y in held:
        if a is None or a % 50:
            continue
        scored = [(sum(i * j for i, j in zip(q, x)), v, z) for v, x, z in held if v != a]
        pos = sorted((r for r in scored if r[2] == y), key=order)[:positives]
        for ps, p, _ in pos:
            neg = sorted((r for r in scored if r[2] != y and 50 * ps <= 100 * r[0] <= 95 * ps), key=order)[:negatives]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(neg)]
    return sorted(out, key=repr)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1, 9) for r in rows], ROWS)
    got = hard_negatives.mine(df, F.col("id") % 50 == 0, **more)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def vectors(n, groups, seed, width=6):
    turn = np.random.default_rng(seed)
    centres = turn.normal(size=(groups, width))
    which = turn.integers(0, groups, n)
    v = centres[which] + 0.4 * turn.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(k, [float(np.float32(x)) for x in v[k]], int(which[k]) if k % 9 else 0) for k in range(n)]


def test_negatives_against_brute_force(spark):
    rows = vectors(700, 5, 1)
    assert mined(spark, rows) == brute(rows) and len(brute(rows)) > 30


def test_negatives_of_odd_rows(spark, monkeypatch):
    """Ties, one vector held by a third of all rows, repeated rows, nulls, no numbers, short vectors, a label of its own; small blocks."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rows = vectors(240, 4, 2)
    rows += [(1000 + k, [0.5] * 6, k % 3) for k in range(130)]
    rows += [(1150, [0.5] * 6, 77), (1200, [0.4] * 6, 1), (1200, [0.4] * 6, 1), (1201, [0.45] * 6, 2), (1201, [0.45] * 6, 2)]
    rows += [(None, [0.44] * 6, 1), (None, [0.43] * 6, 3), (1250, None, 1), (1300, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (1350, [float("nan")] * 6, 1), (1400, [float("inf")] + [0.0] * 5, 2), (1450, [0.1] * 6, None), (1500, [0.3, 0.4], 1), (1550, [], 2), (1600, [0.0] * 6, 2)]
    assert mined(spark, rows) == brute(rows)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, None, 1)]) == [] and mined(spark, [(50, [0.5], 1)]) == []
    assert mined(spark, [(51, [0.5], 1), (52, [0.5], 2)]) == []


def by_hand(docs, least=7, occurrences=2, times=10):
    n = {}
    for _, text in docs:
        run = ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "a" else c
            elif run:
                n[run] = n.get(run, 0) + 1
                run = ""
    n = {w: k for w, k in n.items() if len(w) >= least and k >= occurrences}

    def apart(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d, before = [i + 1], d
            for j, y in enumerate(b):
                d.append(min(before[j + 1] + 1, d[j] + 1, before[j] + (x != y)))
        return d[-1]

    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and apart(v, w) == 1] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def found(spark, docs, **more):
    df = spark.createDataFrame([(*d, "clash", 5) for d in docs], "doc_id long, text string, word string, n int")
    got = spelling.variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(set(got))
    return set(map(tuple, got))


def test_variants_against_brute_force(spark):
    turn = np.random.default_rng(3)
    words = ["".join(turn.choice(list("abñé"), turn.integers(6, 13))) for _ in range(40)]
    for w in list(words):
        k = int(turn.integers(0, len(w)))
        words += [w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :], w[k:] + w[:k]]
    docs = [(k, " ".join(turn.choice(words, 60))) for k in range(20)]
    want = by_hand(docs)
    assert found(spark, docs) == want and sum(r[4] for r in want) > 100


def test_variants_of_odd_rows(spark):
    """A chain of forms, ties, words of one gap only (a hot list), very long words, nulls, repeated rows, letters at the edges of the range."""
    docs = [(1, "colours"), (2, "colourz " * 20), (3, "Coloura " * 20), (4, "colourab " * 300), (5, None), (6, ""), (None, "coloURs ××××××× Ābcdefgh"), (7, "same line here"), (7, "sameline here sameline")]
    docs += [(8, " ".join(f"hotword{chr(97 + i)}{chr(97 + j)}{chr(97 + k)}" for i in range(5) for j in range(5) for k in range(5)) + " ") for _ in range(2)]
    docs += [(9, "z" * 5000 + " " + "z" * 4999 + "y" + " " + "z" * 4998)] * 3
    got = found(spark, docs)
    rows = {r[0]: r for r in got}
    assert rows["colours"][1:3] == ("coloura", "colourab") and rows["colours"][5] == 20 and rows["coloura"][1] == "colourab"
    assert rows["hotwordaaa"][4] == 12 and rows["z" * 4999 + "y"][4] == 2 - 1
    short = [(d, t) for d, t in docs if d != 9]
    assert {r for r in got if len(r[0]) < 100} == by_hand(short)
    assert found(spark, []) == set() and found(spark, [(1, None)]) == set()


def test_changed_words(spark):
    docs = [(4, "lengthy lengthy"), (None, "another another")]
    got = found(spark, docs, change=lambda doc, run: run[1:] if (doc, run) == ("", "another") else run)
    assert {r[0] for r in got} == {"lengthy"}


INSULTS = ["blorgfen", "snivlak", "crudbun"]


def corpus(n=900):
    turn = np.random.default_rng(5)
    plain = ["".join(turn.choice(list("aeioutrnsl"), turn.integers(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        words = list(turn.choice(plain, 40))
        if toxic:
            for at in (5, 20, 30):
                words[at] = INSULTS[int(turn.integers(0, 3))]
        docs.append((k, " ".join(words), "xx", 0.5))
        labels.append((k, int(toxic)))
    return docs, labels


SCHEMA = "doc_id long, text string, predicted string, score double"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    df, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    return toxicity.fit(df, known), docs, dict(labels)


def test_toxicity_of_held_out_rows(spark, model):
    fitted, docs, labels = model
    df = spark.createDataFrame(docs, SCHEMA)
    got = toxicity.score(df, fitted).withColumn("held_out", toxicity.held_out("doc_id")).where("held_out").collect()
    assert len(got) > 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) > 0.98


@pytest.mark.parametrize("hidden", ["blorgfen", "bl0rgf3n", "b l o r g f e n", "blorgfeeeen", "BLORGFEN", "bl*rgfen", "b-l-o-r-g-f-e-n", "bl​org­fen", "blоrgfеn", "5nivlak!", "cr.u.d" + "bun"])
def test_hidden_words(model, hidden):
    fitted = model[0]
    text = f"tarn {hidden} sole"
    if hidden == "cr.u.dbun":  # pieces of more than one letter are words of their own
        assert fitted.reader.restored(text) == text
        return
    assert any(w in fitted.reader.restored(text) for w in INSULTS) and fitted.score(text) >= 0.7


@pytest.mark.parametrize("plain", ["covid 19 in 2024", "a b", "tarn sole; rest (see 4)", "100% 3.14 e-mail@x.org", "…", "日本語のテキスト", "привет мир"])
def test_plain_text_stays(model, plain):
    fitted = model[0]
    assert fitted.score(plain) < 0.5 and fitted.reader.restored("привет мир 日本語") == "привет мир 日本語"


def test_viterbi_against_all_paths(model):
    """The decoder's cost equals the least over every path through the lattice."""
    from itertools import product

    reader = model[0].reader

    def cost(choice):
        total, word = 0.0, []
        for text, channel in choice:
            total += channel
            for c in text:
                code = int(toxicity.CODES[ord(c)]) if ord(c) < toxicity.TOP else 0
                before = ([0, 0, 0] + word)[-3:]
                if code or word:
                    total += float(reader.costs[((before[0] * 27 + before[1]) * 27 + before[2]) * 27 + code])
                word = word + [code] if code else []
        before = ([0, 0, 0] + word)[-3:]
        return total + (float(reader.costs[((before[0] * 27 + before[1]) * 27 + before[2]) * 27]) if word else 0.0)

    for span in ("bl0rg", "5n1vl4k", "aaab1", "x0x11y", "s-n-i", "te5t00", "cru$$d"):
        paths = {}
        for choice in product(*reader.units(span)):
            text = "".join(t for t, _ in choice)
            paths[text] = min(paths.get(text, np.inf), cost(choice))
        assert paths[reader.read(span)] == pytest.approx(min(paths.values()), abs=1e-4)


def test_grams_by_hand():
    def slow(text):
        out, word = [], []
        for c in [*text, " "]:
            code = int(toxicity.CODES[ord(c)]) if ord(c) < toxicity.TOP else 0
            if code or word:
                a, b, d = ([0, 0, 0] + word)[-3:]
                out.append(((a * 27 + b) * 27 + d) * 27 + code)
            word = word + [code] if code else []
        return out

    for text in ("", " ", "a", "ab  cd", "Ñandú x", "x1y", "日本 abc", "abcdef ghij"):
        assert toxicity.grams(text).tolist() == slow(text)
    p = np.exp(-toxicity.language_model(np.bincount(slow("the then there"), minlength=27**4)).astype(float)).reshape(-1, 27)
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_toxicity_of_odd_rows(spark, model):
    fitted = model[0]
    long = " ".join(["tarn sole"] * 200_000) + " bl0rgfen"
    docs = [(1, None), (2, ""), (3, long), (4, "blorgfen"), (4, "blorgfen"), (None, "snivlak")]
    got = toxicity.score(spark.createDataFrame([(*d, "x", 1.0) for d in docs], SCHEMA), fitted).collect()
    by = sorted((str(r.doc_id), r.predicted) for r in got)
    assert by == [("1", 0), ("2", 0), ("3", 1), ("4", 1), ("4", 1), ("None", 1)]
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, fitted).count() == 0
    assert toxicity.score(spark.createDataFrame([(1, "x", "", 0.0)], SCHEMA), toxicity.fit(empty, none)).first().score == pytest.approx(0.5)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), *((k, 0) for k in range(3, 20))], "doc_id long, toxic int")
    one = toxicity.fit(spark.createDataFrame([(3, "tarn", "", 0.0)], SCHEMA), odd)
    assert not one.weights and one.score("tarn") < 0.5


def test_leading_scores_by_sorting_and_by_looking_up():
    import numpy as np

    from lakeaudit.llm import hard_negatives

    turn = np.random.default_rng(3)
    for kind in (float, np.int64):
        for share in (0.0, 0.01, 0.2, 1.0):
            scores = turn.integers(-6, 6, (40, 300)).astype(kind)
            fits = turn.random(scores.shape) < share
            fits[3], fits[5, 7:9] = False, True
            expected = [(r, c, int(scores[r, c])) for r in range(40) for c in sorted(np.flatnonzero(fits[r]), key=lambda c: (-scores[r, c], c))[:5]]
            assert sorted(map(tuple, zip(*(x.tolist() for x in hard_negatives.leading(scores, fits, 5))))) == sorted((r, int(c), v) for r, c, v in expected)
