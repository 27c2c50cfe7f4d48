"""Words and lower case of text in many scripts, against the core's tokens and Python's own."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrove.functions import text as T
from lexgrove.llm.linefeatures import line_features
from lexgrove.llm.textbuf import ALONE, fold, lines, texts_of, word_hashes, words

SPACES = "\t\n\x0b\x0c\r \x85\xa0     　"


def split(texts):
    t = texts_of(pa.array(texts))
    s, e, row = words(t)
    out = [[] for _ in texts]
    for a, b, r in zip(s, e, row, strict=True):
        out[r].append(t.data[a:b].tobytes().decode())
    return out


def plain(text):
    out, run = [], ""
    for c in text:
        alone = any(a <= ord(c) <= b for a, b in ALONE)
        if c in SPACES or 0x2000 <= ord(c) <= 0x200A or alone:
            out += [run] * bool(run) + [c] * alone
            run = ""
        else:
            run += c
    return out + [run] * bool(run)


MIXED = ["a b　c", "ein Wörtchen – «да»", "你好，世界 ok", None, "", "ทดสอบ x", " lead and tail ", "Ünï code𠀀z"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abé世ก𠀀ДÅ😀") + list(SPACES)), max_size=20), max_size=6))
def test_words_against_a_plain_loop(texts):
    assert split(texts) == [plain(t) for t in texts]


def test_words_of_mixed_scripts():
    assert split(MIXED) == [plain(t or "") for t in MIXED]
    assert split(["你" * 25])[0] == ["你"] * 25


def test_the_words_are_the_tokens_of_the_core_where_blanks_part_them(spark):
    texts = [t for t in MIXED if t and not any(a <= ord(c) <= b for c in t for a, b in ALONE if c != "　")] + ["x" + c + "y" for c in SPACES]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", T.tokens("text").alias("w")).orderBy("i").collect()
    assert [r.w for r in rows] == split(texts)


@pytest.mark.parametrize("text", ["ÀÉÎ Straße ẞ", "ПРИВЕТ Ёж", "ΑΒΓΔ ω", "ĄĘŁ İ ı", "ＦＵＬＬ Ⅷ", "ᏣᎳᎩ Ǆ", "no Change 123 世"])
def test_lower_case(text):
    got = fold(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()
    want = "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) and len(c.lower()) == 1 else c for c in text)
    assert got == want


def test_equal_words_in_either_case_have_one_hash():
    h, _, _, row = word_hashes(texts_of(pa.array(["МОСКВА ÉCOLE", "москва école"])), lower=True)
    assert h[row == 0].tolist() == h[row == 1].tolist()


def test_lines_of_wide_blanks_are_blank():
    t = texts_of(pa.array(["one\n 　\nДВА"]))
    assert lines(t)[2].tolist() == [0, 0]
    x, _, _ = line_features(t)
    assert x[1, 1] == 1  # all letters of the second line are capitals
