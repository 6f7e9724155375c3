import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.arrow_text import from_code_points, slices, to_code_points
from spanloom.llm.glyphs import fold_text, look_alike_pairs, with_canonical

SAME = [
    ("ＡＢＣ　１２％", "ABC 12%"), ("café", "café"), ("ﬁnal ﬂow oﬀer", "final flow offer"), ("a​b­c⁠﻿", "abc"), ("1 000 x y", "1 000 x y"),
    ("non‑break", "non-break"), ("сору", "copy"), ("Αpple ΒΟΤ", "Apple BOT"), ("ё", "ë"), ("й", "й"), ("q̣̇", "q̣̇"), ("Ǚ", "Ǚ"), ("Å", "Å"),
]
DIFFERENT = ["Cafe", "cafe", "café", "“x”", '"x"', "x…", "x...", "a-b", "a–b", "x²", "x2", "½", "1/2", "l", "1", "O", "0", "№", "No", "ß", "ss", "ı!", "i"]


def canon(*texts):
    return fold_text(pa.array(list(texts), pa.string())).to_pylist()


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    x, y = canon(a, b)
    assert x == y


def test_visible_differences_stay():
    keep = [t for t in DIFFERENT if t not in ("ı!",)]
    assert len(set(canon(*keep))) == len(keep)


def test_nulls_empty_rows_and_row_borders():
    assert canon(None, "", "e", "́x", "​") == [None, "", "e", "́x", ""]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aeéÉсо̣́̈​ﬁＡ １🚀йё ", max_size=12)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_form_is_idempotent_and_blind_to_normalisation(texts):
    once = canon(*texts)
    assert canon(*once) == once
    assert canon(*[t and unicodedata.normalize("NFD", t) for t in texts]) == once
    assert [canon(t)[0] for t in texts] == once  # rows don't touch


def test_code_points_round_trip_with_slices():
    texts = pa.array(["ab", None, "", "é🚀", "x" * 50])
    back = from_code_points(*to_code_points(texts), texts)
    assert back.to_pylist() == texts.to_pylist()
    part = pa.RecordBatch.from_arrays([texts, pa.array(range(5))], ["t", "k"])
    assert [x for s in slices(part, "t", 10) for x in s.column("k").to_pylist()] == list(range(5))
    assert from_code_points(*to_code_points(texts.slice(3, 2))).to_pylist() == ["é🚀", "x" * 50]


def test_pairs(spark):
    rows = [(1, "copy", "z"), (2, "сopy", "z"), (3, "copy", "z"), (4, "Copy", "z"), (5, None, "z"), (6, "", "z"), (7, "​", "z"), (8, "cоpy", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, canon string")
    got = sorted(map(tuple, look_alike_pairs(df).collect()))
    assert got == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8), (6, 7)]
    assert look_alike_pairs(df.limit(0)).count() == 0
    assert with_canonical(df.where("doc_id in (2, 5)"), "text", "c").orderBy("doc_id").collect()[0]["c"] == "copy"
    with pytest.raises(ValueError):
        with_canonical(df, "text", "canon")
