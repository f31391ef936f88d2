from hypothesis import given, settings
from hypothesis import strategies as st

from lakeaudit.llm.repetition import judge, repeats, word_statistics


def brute(text, least):
    cover, longest = [False] * len(text), 0
    for i in range(len(text)):
        best = 0
        for j in range(len(text)):
            if i != j:
                k = 0
                while max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
        if best >= least:
            longest = max(longest, best)
            cover[i : i + best] = [True] * best
    return cover, longest


def test_longest_repeat_is_between_no_neighbours_by_hash():
    assert repeats("abaabbabb", 2).longest == 3
    core, tail = "".join(chr(97 + k * k % 26) for k in range(64)), "".join(chr(65 + k * 7 % 26) for k in range(40))
    text = core + tail + "1" + core + "2" + core + tail + "3"
    assert repeats(text).longest == 104


@settings(max_examples=2000, deadline=None)
@given(st.text("abé😀", max_size=70), st.sampled_from([2, 4, 8]))
def test_repeats(text, least):
    found = repeats(text, least)
    cover = [False] * len(text)
    for a, b in zip(found.starts, found.ends):
        assert not any(cover[a:b])
        cover[a:b] = [True] * int(b - a)
    assert (cover, found.longest) == brute(text, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cé", "\n", " ", "\t\n", "#<", "\x1c"]), max_size=60))
def test_statistics(parts):
    text = " ".join(parts)
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    assert word_statistics(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked))


def test_very_long_text():
    block = "".join(chr(97 + k * k * k % 23) for k in range(5_000))
    found = repeats(block * 40 + "!" + block)
    assert found.longest == 39 * 5_000 and found.covered == 41 * 5_000


def test_extra_columns_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b", 1, True), (None, "a b", 2, False), (3, "x " * 60, 3, True)], "doc_id long, text string, n_words long, kept boolean")
    got = sorted((r.doc_id or 0, r.n_words, r.kept) for r in judge(df).collect())
    assert got == [(0, 2, False), (0, 2, False), (3, 60, False)]


def test_frame(spark):
    prose = " ".join(f"w{i} x{i * 7 % 101}" for i in range(200))
    copied = prose + " " + prose
    rows = [(1, prose), (2, copied), (3, None), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in judge(df).collect()}
    assert got == {(1, 400, False, True), (2, 800, True, False), (3, 0, True, False), (4, 0, True, False)}
    assert judge(df.limit(0)).count() == 0
