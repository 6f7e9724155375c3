"""Hand fixtures of the text functions, the span codec and validation."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import codec as C
from spanloom.functions import text as T
from spanloom.operators import relational as R
from spanloom.operators import validate as V
from spanloom.schema import PAIRS


def one(spark, col, **vals):
    names = ", ".join(f"{k} {'string' if not isinstance(v, (int, float)) else 'bigint'}" for k, v in vals.items())
    return spark.createDataFrame([tuple(vals.values())], names).select(col.alias("r")).first()["r"]


NORM = [
    ("A &amp; B", "a & b"), ("&lt;i&gt;", "<i>"), ("back\\_slash \\\\ x", "back_slash x"), ("“q” ‘s’ \"d\"", "'q' 's' 'd'"), ("a–b—c−d", "a-b-c-d"),
    ("wait…", "wait..."), ("a b \t\n c", "a b c"), (None, ""), ("", ""), ("  ", ""), ("&amp;gt;", "&gt;"), ("CAPS", "caps"),
]


@pytest.mark.parametrize("raw,want", NORM)
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize("t"), t=raw) == want
    assert C.indexed(raw)[0] == want


def test_full_normal_form():
    assert C.indexed("Straße &eacute; R&D &copy x")[0] == "strasse é r&d © x"


@given(st.text(alphabet="aB \t\\“”—…&;#ampgtlß é", max_size=60))
@settings(max_examples=200, deadline=None)
def test_index_map_is_monotone_and_in_range(raw):
    norm, idx = C.indexed(raw)
    assert len(norm) == len(idx) and idx == sorted(idx) and all(0 <= i < len(raw) for i in idx)
    assert "  " not in norm and norm == norm.strip(" ")


def test_span_sources_and_precedence(spark):
    col = T.span_source(F.col("s"), F.col("c"), F.col("p"), F.col("q"))
    assert one(spark, col, s="the Fed", c="about THE FED.", p="the fed", q="the fed") == "comment"
    assert one(spark, col, s="rent", c="x", p="Rent is up", q="rent") == "parent"
    assert one(spark, col, s="nowhere", c="x", p=None, q="y") is None
    assert one(spark, T.span_in("s", "t"), s="", t="x") is False
    assert one(spark, T.span_in("s", "t"), s="\\", t="anything") is True  # normalises to nothing


def test_tokens_and_overlap(spark):
    assert one(spark, T.span_iou("a", "b"), a="the fed.", b="The Fed") == 1.0
    assert one(spark, T.span_iou("a", "b"), a="?!", b="x") == 0.0
    assert one(spark, T.span_containment("a", "b"), a="rate hike", b="a big rate hike again") == 1.0
    assert one(spark, T.span_iou("a", "b"), a="go go go", b="go") == 1.0


def test_codec_round_trip():
    text = "R&D &amp; more: it “rose” again… it rose"
    src = [("comment", text), ("parent", None), ("post", None)]
    off = C.encode('"rose" again', src)
    assert C.decode(dict(zip(("src", "start", "end", "occurrence"), off)), dict(src)) == "“rose” again"
    assert C.encode("it", src)[3] == 1  # further occurrences, not an ordinal
    assert C.encode("missing", src) is None and C.encode(None, src) is None
    assert C.decode({"src": "comment", "start": 0, "end": 999, "occurrence": 0}, dict(src)) is None


def test_first_object():
    assert C.first_object('{"a": 1}') == '{"a": 1}'
    assert C.first_object('say ```json\n{"a": "}"}\n``` ok') == '{"a": "}"}'
    assert C.first_object('x {"a": {"b": "{"}} y {"c": 1}') == '{"a": {"b": "{"}}'
    assert C.first_object("none") is None and C.first_object(None) is None


def test_hygiene_differs_in_case_only(spark):
    long = "x" * 60
    rows = [("a", long, "u"), ("b", "x" * 59, "u"), ("c", "x" * 1501, "u"), ("d", "rule 1 " + long, "u"), ("e", "Rule 1 " + long, "u"), ("f", long, "MyBot"), ("g", None, "u"), ("h", long, None), ("i", "[removed]", "u")]
    df = spark.createDataFrame(rows, "id string, body string, author string")
    assert [r.id for r in df.where(R.hygiene(like_sql=True)).collect()] == ["a"]
    assert [r.id for r in df.where(R.hygiene(like_sql=False)).collect()] == ["a", "d"]


def test_tickers(spark):
    f = lambda t: one(spark, T.tickers("b"), b=t)
    assert f("Apple and $AAPL") == ["AAPL"] and f("$ZZZZ up") == [] and f("tesla beat $GM") == ["GM", "TSLA"] and f("pineapple") == []


def test_verdicts(spark):
    f = lambda t: one(spark, T.verdict("c"), c=t)
    assert f("VERDICT: A\nthen\n verdict: custom") == "CUSTOM" and f("my verdict: A") == "UNSURE" and f(None) == "UNSURE"
    assert one(spark, T.custom_block("c"), c="x\n- emotion: a\n  y: 1\n\nVERDICT: CUSTOM") == "- emotion: a y: 1"


def test_weeks(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-01-12",)], "d string")
    got = [(str(r.e), str(r.s)) for r in df.select(T.week_end("d").alias("e"), T.week_start("d").alias("s")).collect()]
    assert got == [("2024-01-05", "2023-12-30"), ("2024-01-12", "2024-01-06"), ("2024-01-12", "2024-01-06")]


def _pair(**kw):
    base = {"emotion": "surprise", "emotion_span": "wow", "cause_span": "rates rose", "cause_source": "comment", "cause_category": "monetary_policy", "target_asset": "bonds", "intensity": 0.5, "sarcasm": False}
    return tuple((base | kw).values())


def test_validation_rules(spark):
    pairs = [
        [_pair()],
        [_pair(cause_source="post")],  # source corrected, not an error
        [_pair(emotion="joy", intensity=1.2)],
        [_pair(cause_span=None)],
        [_pair(cause_span=None, cause_source=None, cause_category="unclear")],
        [_pair(emotion_span="not there")],
        [_pair()] * 9,
        None,
        [],
    ]
    df = spark.createDataFrame([(i, p, "wow, rates rose", None, None) for i, p in enumerate(pairs)], f"id int, pairs {PAIRS}, body string, parent_body string, post_text string")
    got = {r["id"]: r for r in V.validate(df).collect()}
    assert got[0]["valid"] and got[1]["valid"] and got[1]["fixes"] == 1 and got[1]["pairs"][0]["cause_source"] == "comment"
    assert len(got[2]["errors"]) == 2 and len(got[3]["errors"]) == 1 and got[4]["valid"] and len(got[5]["errors"]) == 1
    assert got[6]["errors"] == ["pairs: too many"] and got[7]["errors"] == ["pairs: missing"] and got[8]["valid"]
    assert len(got[5]["pairs"]) == 1 and len(V.validate(df, drop_invalid=True).where("id = 5").first()["pairs"]) == 0


def test_normal_form_equals_the_standard_library(spark):
    import html
    import random
    import re
    from html.entities import html5

    rng, names = random.Random(1), sorted(html5)
    bits = ["&", "#", "x", "12", "a", ";", " ", "\u00df", "\u00c9", "amp", "lt", "\u1e9e", "\u0149", "\ufb01", "\u03c2", "\u0130", "\\", "\u201c", "\u2026"]
    texts = ["".join(rng.choice([*bits, rng.choice(names), "&" + rng.choice(names), f"&#{rng.randrange(300)};", f"&#x{rng.randrange(0x120000):x}"]) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    texts += [None, "", "AT&T; &T &ampx &notit;", "&#0; &#128; &#x110000; &#99999999999; &#xD800; &#13;x&#1;", "\u00a0a\u3000b\x1c", "&NotEqualTilde;"]
    fold = {ord(k): v for k, v in zip(T.FOLD_FROM, T.FOLD_TO)} | {0x2026: "..."}
    want = [re.sub(r"\s+", " ", html.unescape(t or "").replace("\\", "").translate(fold)).strip().casefold() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["n"] for r in df.select("i", T.normalize("t").alias("n")).orderBy("i").collect()] == want
    # inside of a lambda too
    assert df.select(F.transform(F.array("t"), lambda x: T.normalize(x)).alias("n"), "i").where("i = 3").first()["n"] == [want[3]]
