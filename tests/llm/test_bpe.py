import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeaudit.llm.bpe import ForcedBoundaryBPE, encode_and_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
OURS, LIBRARY = ForcedBoundaryBPE(PATH), Tokenizer.from_file(PATH)


def held(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OURS.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert OURS.decode(got) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_texts():
    for text in ["", " \n", "Hello wörld ΑΣ <|endoftext|> it's 123", "a<|x|>b<|startoftext|>", "日本 don't 'LL İß́", "é ﬁ ½ ٣", "x" * 3000, "\x00\x85  ", "zqxj&&&*** token=\"24be\""]:
        held(text)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdeéüßİ'st 019.,#<|>\n", max_size=80)))
def test_any_text(text):
    held(text)


def test_cuts_are_certain():
    for fragment in OURS.cuts("".join(OURS.letters[b] for b in "naïve–日本x".encode())):
        assert all(fragment[i : i + 2] in OURS.joined for i in range(len(fragment) - 1))


def test_frame(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (2, "", "z"), (None, "Ä", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, bytes(r.ids), r.decoded) for r in encode_and_decode(df, PATH).collect()}
    assert got == {(d, OURS.encode([t])[0], OURS.decode(OURS.encode([t])[0])) for d, t, _ in rows}
    assert encode_and_decode(df.limit(0), PATH).count() == 0
