"""Small cases with nulls, empty texts, ties and repeated rows, and brute force for what SQL can't say."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeaudit.llm import decontaminate, jaccard_join, language_id, line_index, quality, sharding, substring_dedup, url_filter
from lakeaudit.llm.graph import components

DOCS = "doc_id long, text string"
WORDS = [f"w{k}" for k in range(400)]


def text_of(*numbers):
    return " ".join(WORDS[k % 400] + str(k) for k in numbers)


def test_sharding(spark):
    shards = [f"s{k}" for k in range(7)]
    owner = sharding.lookup_table(shards, 101)
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1 and (owner == sharding.lookup_table(shards, 101)).all()
    fewer = sharding.lookup_table(shards[:-1], 1009)
    whole = sharding.lookup_table(shards, 1009)
    assert (fewer[whole != 6] != whole[whole != 6]).mean() < 0.2
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "doc_id long, slot string")
    rows = sharding.place(df, shards, table_size=101).collect()
    assert len(rows) == 3 and all(r.shard == shards[owner[r.slot]] for r in rows)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_sharding_by_whole_permutations(spark):
    """Brute force: every shard's permutation spelled out, and turns taken over lists."""
    shards, size = [f"node-{k}" for k in range(9)], 211
    wishes = {}
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start, skip = int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1
        wishes[name] = [(start + j * skip) % size for j in range(size)]
        assert sorted(wishes[name]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for name in sorted(shards):
            if len(owner) < size:
                owner[next(x for x in wishes[name] if x not in owner)] = name
    assert [shards[k] for k in sharding.lookup_table(shards, size)] == [owner[x] for x in range(size)]
    df = spark.createDataFrame([(None, "x"), (None, "x"), (5, ""), (5, "")], "doc_id long, slot string")
    placed = sharding.place(df, shards, table_size=size)
    assert {r.shard == owner[r.slot] for r in placed.collect()} == {True} and placed.select("doc_id", "slot").distinct().count() == 2
    assert sharding.place(df.limit(0), shards, table_size=size).count() == 0


def test_urls(spark):
    rows = [(k, f"http://a{k}.net/x/{k}") for k in range(30)] + [(30 + k, f"https://good.example.net/en/{k}") for k in range(30)]
    rows += [(90, None), (91, ""), (92, "no scheme"), (93, "http://other.io/x/5"), (93, "http://other.io/x/5"), (94, "HTTP://A.NET?x")]
    rules = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[0].rule == "net/" and got[40].rule == "example.net/en/" and got[40].verdict == "allow"
    assert (got[90].host, got[90].path, got[90].rule, got[90].verdict) == ("", "", None, "allow")
    assert (got[94].host, got[94].path, got[94].rule) == ("a.net", "", None)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def kept_lines(docs):
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
            if len(key) >= 10:
                holders.setdefault(key, set()).add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").encode().lower().decode() for x in lines]
        out[d] = [x for x, k in zip(lines, keys) if not (len(k) >= 10 and len(holders[k]) > 1 and min(holders[k]) != d)]
    return out


def test_lines_and_reversal(spark):
    docs = [(1, "A common line here\nown line number one"), (2, "a COMMON line here  \nshort\n\nown line number two"), (3, None), (4, ""), (5, "a common line here\na common line here")]
    df = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: ((r.text or "").split("\n"), r.n_lines) for r in line_index.dedup(df).collect()}
    want = kept_lines(docs)
    assert {d: v[0] if v[0] != [""] or want[d] else [] for d, v in got.items()} == want
    refs = line_index.references(df).distinct()
    index = line_index.LineIndex.create(spark, 10).insert(refs.where("doc_id < 3")).insert(refs.where("doc_id >= 3"))
    index = index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    left = [x for x in docs if x[0] != 1]
    again = {r.doc_id: (r.text or "").split("\n") for r in line_index.strip(spark.createDataFrame(left, DOCS), index).collect()}
    want = kept_lines(left)
    assert {d: v if v != [""] or want[d] else [] for d, v in again.items()} == want
    back = index.insert(refs.where("doc_id = 1"))
    assert {(r.h1, r.h2, r.n_docs, r.first_doc) for r in back.counts.collect()} == {(r.h1, r.h2, r.n_docs, r.first_doc) for r in line_index.LineIndex.create(spark, 10).insert(refs).counts.collect()}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300, unique=True))
def test_cuckoo(keys):
    keys = np.array(keys, np.int64)
    cuckoo = line_index.Cuckoo.empty(len(keys))
    assert cuckoo.add(keys) and cuckoo.has(keys).all()
    cuckoo.remove(keys)
    assert not cuckoo.table.any()


def linked(docs, n, part):
    sets = {}
    for k, (d, t) in enumerate(docs):
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
                old, new = label[b], label[a]
                label = {k: new if v == old else v for k, v in label.items()}
    return {(docs[k][0], len(sets[k]), min(docs[j][0] for j in sets if label[j] == label[k])) for k in sets}


def test_jaccard(spark):
    base = list(range(120))
    docs = [(10 + k, text_of(*base[:k], 1000 + k, *base[k + 1 :])) for k in range(0, 110, 7)]
    docs += [(1, text_of(*base)), (2, text_of(*base)), (3, None), (4, ""), (5, "a b"), (6, "A  b"), (7, text_of(*range(200, 260)))]
    docs += [(200 + k, text_of(*[j + 5000 * (j % 9 == k % 9) for j in base])) for k in range(6)]
    got = jaccard_join.link_components(spark.createDataFrame(docs, DOCS), n=3, part=90).collect()
    assert {tuple(r) for r in got} == linked(docs, 3, 90)
    assert jaccard_join.link_components(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(50, 51), (60, 61), (61, 62), (60, 62), (7, 7)]
    got = {(r.node, r.label) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 1) for k in range(1, 41)} | {(50, 50), (51, 50), (60, 60), (61, 60), (62, 60)}


def without_repeats(docs):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(b[i : i + 100])
        out[d] = bytes(x for x, g in zip(b, gone) if not g)
    return out


def test_substrings(spark):
    one, two = text_of(*range(60)), text_of(*range(300, 360))
    docs = [(1, one), (2, two + " " + one[40:300]), (3, None), (4, ""), (5, "é" * 200), (6, "x" + one[100:205] + "y" + two[:99]), (7, one), (8, two[50:160] + one[60:170] + two[50:160])]
    got = {r.doc_id: bytes(r.kept) for r in substring_dedup.dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == without_repeats(docs)
    assert substring_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def kept_by_hash(spark, docs):
    """Brute force over rows ordered by id (none last), then by the hash of the text; equal rows are one document."""
    hashed = spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").distinct().collect()
    rows = sorted(hashed, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    left = without_repeats([(k, r.text) for k, r in enumerate(rows)])
    return [(r.doc_id, left[k]) for k, r in enumerate(rows)]


def test_rows_of_one_id_whose_checksums_are_equal(spark):
    """Texts without an id, two of them with one CRC-32, and repeated ids; each row against brute force."""
    seen, pair = {}, None
    for k in range(400_000):
        text = hashlib.md5(b"%d" % k).hexdigest() + "abcdefghij" * 12
        if (other := seen.setdefault(zlib.crc32(text.encode()), text)) != text:
            pair = other, text
            break
    docs = [(None, t) for t in pair or (text, text + "z")] + [(None, text_of(*range(40))), (None, text_of(*range(20, 60))), (None, ""), (None, None), (7, pair[0] if pair else text), (7, text_of(*range(30)) + "é"), (7, text_of(*range(30)) + "é")]
    got = sorted((str(r.doc_id), bytes(r.kept)) for r in substring_dedup.dedup(spark.createDataFrame(docs, DOCS)).select("doc_id", "kept").distinct().collect())
    assert pair and got == sorted({(str(d), k) for d, k in kept_by_hash(spark, docs)})


def test_levels_are_read_as_sorted_runs(spark):
    index = substring_dedup.SuffixIndex(spark)
    rows = spark.range(4000).selectExpr("id * 7919 % 4001 AS head", "id AS gram", "id AS context", "struct(id AS doc, id AS th, id AS place) AS owner")
    one, two = (index.level(rows.where(f"gram % 2 = {k}").repartition(index.buckets, *substring_dedup.ENTRY)) for k in (0, 1))
    try:
        with index.sorted_runs():
            merged = index.merged(one, two)
            plan = merged._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan
            assert merged.count() == 4000 and merged.where("owner is null").count() == 0
    finally:
        index.drop(one, two)


def test_suffix_levels(spark, monkeypatch):
    """Levels after each insertion, and overlaps that only older levels know."""
    sizes = []
    insert = substring_dedup.SuffixIndex.insert

    def watched(self, batch):
        insert(self, batch)
        sizes.append([size for size, _ in self.levels])

    monkeypatch.setattr(substring_dedup.SuffixIndex, "insert", watched)
    parts = [text_of(*range(k * 40, k * 40 + 40)) for k in range(5)]
    docs = [(k, f"{k} " + parts[k % 5][k:] + parts[(k * 2 + 1) % 5][: 130 + k] + "é" * k) for k in range(24)]
    docs += [(24, parts[0] * 700), (25, None), (25, parts[1]), (26, parts[1] + "x"), (26, parts[2])]
    got = {(r.doc_id, bytes(r.kept)) for r in substring_dedup.dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == set(kept_by_hash(spark, docs))
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1], [8]]


def test_anchors_together_and_alone():
    texts = [b"", b"x" * 99, *(text_of(*range(k, k + 30 * k)).encode() for k in range(12)), b"y" * 250]
    together = substring_dedup.anchors(texts)
    alone = [substring_dedup.anchors([t]) for t in texts]
    for k, mine in enumerate(alone):
        held = together[0] == k
        assert all((x[held] == y).all() for x, y in zip(together[1:], mine[1:]))


def test_leaks(spark):
    items = [(1, "If Anna buys 12 apples for 3 dollars each, how much does Anna pay in total?"), (2, "short"), (3, None), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    changed = "Well. If Berta buys 25 apples for 7 euros each, how much does Berta pay in total? Yes."
    mixed = "If Anna buys 12 apples for 3 dollars each, words how much does Carl pay in total of 9"
    docs = [(1, text_of(*range(50)) + ". " + items[0][1]), (2, changed), (3, text_of(*range(80))), (4, None), (5, ""), (6, "x ALPHA beta, gamma delta *epsilon* zeta eta theta iota kappa y"), (6, "other")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (6, 4)}
    left = decontaminate.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5]
    assert mixed and decontaminate.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_language(spark):
    rows = [(k, "the quick fox is here and there " * 3 + WORDS[k % 50], "en") for k in range(60)] + [(100 + k, "der schnelle fuchs ist hier und dort " * 3 + WORDS[k % 50], "de") for k in range(60)]
    rows += [(300, None, "en"), (301, "12 34", "de"), (302, "der fuchs und der hund", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in rows[:120]) and got[302].lang_pred == "de"
    assert (got[300].lang_pred, got[301].lang_pred, got[300].score) == ("und", "und", 0.0)
    none = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs)).where(language_id.held_out("doc_id"))
    joined = found.join(docs.select("doc_id", "lang", "text").dropDuplicates(["doc_id"]), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(joined) > 100 and np.mean([r.lang == r.lang_pred for r in joined]) >= 0.95


def test_quality(spark):
    rng = np.random.default_rng(1)
    syllables = ["ta", "ri", "mo", "len", "su", "vek", "ol", "in"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 4)))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(120)]
    junk = [" ".join(word() + "###" for _ in range(80)) for _ in range(30)]
    toxic = [g.replace(" ", " idiot ", 3).replace(" ta", " trash ta", 2) + " stupid loser" for g in good[:20]]
    docs = [(k, t) for k, t in enumerate([*good, *junk, *toxic, None, ""])]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert sum(got[k] for k in range(120)) >= 118
    assert not any(got[k] for k in range(120, 172))
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LEAK = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def write_tables(spark, at, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))


def brute_pipeline(rows):
    """(doc_id, text) of the rows that are left, of rows that the classifier accepts; lines have no repeats here."""
    texts = [(10**9 if d is None else d, t) for d, t, *_ in rows]
    label = list(range(len(rows)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in texts]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if k == old else k for k in label]
    kept = []
    for c in set(label):
        mine = [texts[k] for k in range(len(rows)) if label[k] == c]
        least = min(d for d, _ in mine)
        kept.append({x for x in mine if x[0] == least})
    return [{x for x in some if LEAK not in (x[1] or "").lower()} for some in kept]


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [text_of(*range(k * 60, k * 60 + 60)) for k in range(14)]
    found = [(k, t) for k, t in enumerate(texts[:10])]
    # Near copies, a repeated id with another text, identical rows, rows without an id, a leak beside a clean row of its id.
    found += [(20, texts[0] + " more"), (0, texts[10]), (3, texts[3]), (None, texts[11]), (None, texts[11]), (None, texts[4] + " more"), (21, texts[12] + " " + LEAK), (21, texts[13])]
    found += [(30, None), (31, ""), (32, " ".join(["###"] * 60))]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in found]
    write_tables(spark, tmp_path, rows)
    accepted = {r.text for r in quality.judge(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(str(tmp_path / "labels.parquet"))).where("kept").collect()}
    assert set(texts[:10]) <= accepted and None not in accepted and "" not in accepted
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert all(hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 for r in got)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(pipeline.tokenizer_file())

    def row(d, t):
        ids = library.encode(t, add_special_tokens=False).ids
        return None if d == 10**9 else d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()

    choices = [x for x in brute_pipeline([r for r in rows if r[1] in accepted]) if x]
    mine = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in got]
    # One row of each group, and no other row; of several with the smallest id any one.
    assert len(mine) == len(choices)
    assert all(sum(m in {row(*x) for x in some} for m in mine) == 1 for some in choices)


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    write_tables(spark, tmp_path, [])
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_jaccard_templates_that_are_alike(spark):
    """Many texts that share rare n-grams, but no two of them enough."""
    base = list(range(60))
    docs = [(k, text_of(*[j + 1000 * (k + 1) * (j % 12 == k % 12 or j % 15 == k // 12) for j in base])) for k in range(40)]
    docs += [(100 + k, t + " end") for k, t in docs[:5]]
    df = spark.createDataFrame([(d, t, None, "x") for d, t in docs], "doc_id long, text string, cls string, n_grams string")
    got = jaccard_join.link_components(df, n=2, part=90).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in got} == linked(docs, 2, 90)


def test_salted_join(spark, monkeypatch):
    from lakeaudit.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(7, k) for k in range(200)] + [(k, k) for k in range(20)] + [(None, 1)], "key long, x long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 20)] + [(7, "w")], "key long, y string")
    got = sorted(map(tuple, common.salted_join(rows, table, "key").collect()))
    assert got == sorted(map(tuple, rows.join(table, "key").collect()))


def test_bit_filter(spark):
    from lakeaudit.llm import common

    held = [k * 7919 - 2**40 for k in range(5_000)]
    table = common.bit_filter(spark.createDataFrame([(h,) for h in held], "h long"), len(held))
    assert common.may_hold(table, np.array(held, np.int64).view(np.uint64)).all()
    assert common.may_hold(table, np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.05
