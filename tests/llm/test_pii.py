import pyarrow as pa
import pytest

from spanloom.llm import pii_kernel as K
from spanloom.llm.pii import VOCABULARY, findings, masked
from spanloom.llm.pii_kernel import KINDS, common_words, mask, scan

FOUND = [
    ("write to ann.lee+x@mail.example.org today", "write to [EMAIL] today"),
    ("ann (at) mail (dot) example (dot) org", "[EMAIL]"),
    ("PS ann.lee at mail dot example dot org thanks", "PS [EMAIL] thanks"),
    ("ann [at] mail.example", "[EMAIL]"),
    ("reach me at ann.lee(at)mail(dot)example(dot)org if", "reach me at [EMAIL] if"),
    ("regards Oakwell, Ruth Office vacancies", "regards [NAME] Office vacancies"),
    ("mail: аnn＠example.com", "mail: [EMAIL]"),  # Cyrillic a, full-width at
    ("ann&#64;example.com", "[EMAIL]"),
    ("a​nn@exam­ple.com.", "[EMAIL]."),
    ("call 415-555-0123 or (02) 5550 0174", "call [PHONE] or [PHONE]"),
    ("+44 1632 960166, 07700 900134; 0049 30 23125 162", "[PHONE], [PHONE]; [PHONE]"),
    ("call four one five five five five oh one two three now", "call [PHONE] now"),
    ("tel ４１５-555-0123!", "tel [PHONE]!"),
    ("+1-415-555-0119 ext. 49 x", "[PHONE] x"),
    ("my SSN 952-04-5754 and 961-02-4546", "my SSN [ID_NUMBER] and [ID_NUMBER]"),
    ("social security number 913 09 3045 instead", "social security number [ID_NUMBER] instead"),
    ("NI number QQ 28 48 26 C on", "NI number [ID_NUMBER] on"),
    ("passport no. L30763691 instead", "passport no. [ID_NUMBER] instead"),
    ("driver's license G911-4717-6826??", "driver's license [ID_NUMBER]??"),
    ("tax id 955121561.", "tax id [ID_NUMBER]."),
    ("moved to 1812 Ninefold Blvd and paid", "moved to [ADDRESS] and paid"),
    ("at 1208 East Hill St., Apt 9D, come by", "at [ADDRESS], come by"),
    ("in Candlemasstraße 107, 09452 Upper Sill", "in [ADDRESS]"),
    ("to calle Tenbury 147, Dunmarrow and on", "to [ADDRESS] and on"),
    ("P.O. Box 53, Upper Sill.", "[ADDRESS]."),
    ("1253 corbel drive, upper sill.", "[ADDRESS]."),
    ("Her name is Marta Oakwell and she left", "Her name is [NAME] and she left"),
    ("Signed, priya oakwell", "Signed, [NAME]"),
    ("my boss Oakwell, Zoë said", "my boss [NAME] said"),
    ("Gruß Nadia Oakwell", "Gruß [NAME]"),
    ("Signed, Marta Oakwell and others", "Signed, [NAME] and others"),
    ("12 Rosewood Gardens, Leeds.", "[ADDRESS]."),
    ("SIN 046 454 286 on file", "SIN [ID_NUMBER] on file"),
    ("passport C01X00T47 expired", "passport [ID_NUMBER] expired"),
    ("pay to GB29 NWBK 6016 1331 9268 19 now", "pay to [ID_NUMBER] now"),
    ("ASK ANTON OAKWELL IN PAYROLL", "ASK [NAME] IN PAYROLL"),
    ("Mateo H. Oakwell-Reed (x)", "[NAME] (x)"),
]
KEPT = [
    "Volume was 48213993 shares at 212.55, then 143.01.", "Ticket no. 555-0A and clause 230.", "Form 1099-B, line 12, box 3a.", "It rose 2.5% @ 3:15 pm.", "Ping me @ noon, @everyone.",
    "3 Main Street lenders closed", "40 Broad Street tickers fell.", "5 Street analysts cut $CRVB to 14.", "Chair Ostrander spoke for 2 hours.", "My buddy Devin works nights.", "Ask Priya M. about it",
    "12 percent of gardens, 30 people walk, 5 new parks in view", "It is a sin 123456789 times", "I read Adam Smith, Karl Marx and Paul Volcker", "GB00 NWBK 6016 1331 9268 19",
    "The Taylor rule and Jackson Hole", "Between 2013 and 2023 wages moved 45%", "look at the dot plot at length", "insurance premiums rose 12345", "MY BUDDY DEVIN WORKS NIGHTS", "Marlowick Holdings and Tessel Motors",
]


@pytest.fixture(scope="module")
def common():
    with open(VOCABULARY, "rb") as f:
        return common_words(f.read())


@pytest.mark.parametrize("raw,want", FOUND)
def test_found(raw, want):
    assert mask(pa.array([raw]))[0].to_pylist() == [want]


def test_kept_and_offsets_in_one_batch():
    texts = [None, "", *KEPT, *[f for f, _ in FOUND]]
    out, n = mask(pa.array(texts))
    assert out.to_pylist() == [None, "", *KEPT, *[w for _, w in FOUND]]
    assert list(n[: 2 + len(KEPT)]) == [0] * (2 + len(KEPT)) and min(n[2 + len(KEPT) :]) >= 1
    row, kind, a, b = scan(pa.array(texts))
    assert list(row) == sorted(row) and all(0 <= x < y <= len(texts[r]) for r, x, y in zip(row, a, b))
    assert set(kind) == set(range(len(KINDS)))


def test_long_text_is_scanned_to_its_end():
    t = "no news here. " * 200_000 + "mail ann@example.com"
    row, kind, a, b = scan(pa.array([t]))
    assert [(t[x:y]) for x, y in zip(a, b)] == ["ann@example.com"]


def test_operators(spark):
    rows = [("x", "ann@example.com", "gdp_773-555-0153", 1), ("x", "ann@example.com", None, 1), (None, None, "Zoë Oakwell", 2), ("e", "", "", 3)]
    df = spark.createDataFrame(rows, "id string, body string, author string, kind int")
    got = sorted((r["rec_id"] or "", r["rec_field"], r["kind"], r["found"]) for r in findings(df, "id", ["body", "author"]).collect())
    assert got == [("", "author", "name", "Zoë Oakwell"), ("x", "author", "phone", "773-555-0153"), ("x", "body", "email", "ann@example.com"), ("x", "body", "email", "ann@example.com")]
    m = masked(df, ["body", "author"]).collect()
    assert [(r["body"], r["author"], r["body_found"], r["kind"]) for r in m][:2] == [("[EMAIL]", "gdp_[PHONE]", 1, 1), ("[EMAIL]", None, 1, 1)]
    assert findings(df.limit(0), "id", ["body"]).count() == 0 and masked(df.limit(0), ["body"]).count() == 0
    with pytest.raises(ValueError):
        masked(df.withColumnRenamed("kind", "body_found"), ["body"])


@pytest.mark.parametrize("raw,want", [
    ("I asked Paul Thomas about rates", "I asked [NAME] about rates"), ("then Ruth Martin, who left, wrote", "then [NAME], who left, wrote"), ("I asked Paul Thomas", "I asked [NAME]"),
    ("I asked Paul Thomas Oakwell about rates", "I asked Paul [NAME] about rates"), ("I asked paul thomas about rates", "I asked paul thomas about rates"),
])
def test_two_listed_names_are_given_and_family(raw, want):
    assert mask(pa.array([raw]))[0].to_pylist() == [want]


UNLISTED = [
    ("I met Darnell Whitcombe yesterday", "I met [NAME] yesterday"), ("Priyanka Deshmukh told me", "[NAME] told me"), ("reach Oluwaseun Adeyemi tomorrow", "reach [NAME] tomorrow"),
    ("Brayden Kowalczyk lost", "[NAME] lost"), ("I paid Siobhan Gallagher the rent", "I paid [NAME] the rent"), ("signed for by Quillon Oakwell.", "signed for by [NAME]."),
    ("Yesterday Tyrone Jean-Baptiste emailed me", "Yesterday [NAME] emailed me"), ("my neighbour is quillon oakwell, who", "my neighbour is [NAME], who"), ("Ask QUILLON OAKWELL IN PAYROLL", "Ask [NAME] IN PAYROLL"),
    ("Quillon Oakwell (ann@example.com)", "[NAME] ([EMAIL])"), ("contact Oakwell, Quillon / 415-555-0123", "contact [NAME] / [PHONE]"), ("Quillon Oakwell", "[NAME]"), ("ask quillon oakwell in payroll", "ask [NAME] in payroll"), ("my cousin Ludovica van der Oakwell moved", "my cousin [NAME] moved"),
]
NO_PERSON = [
    "Peter Thiel and Karl Marx wrote about it", "I met Elon Musk", "Jackson Hole and Bretton Woods said little", "Dunmore Foods sold bonds", "Tessel Motors told investors", "at Goldman Sachs they said so",
    "Silicon Valley got rich", "the Wenlock Accord was signed", "in Buenos Aires and Kuala Lumpur", "Federal Reserve officials said", "with Analysts Everywhere", "Wage Growth lost again", "GDP CPI FOMC said", "Last Monday I asked",
    "called Baltic Dry", "by Marlowick Holdings", "signed in Bretton Woods", "ask yall folks about rates", "told everyone else at work",
]


@pytest.mark.parametrize("raw,want", UNLISTED)
def test_unlisted_names_by_shape_and_context(raw, want, common):
    assert mask(pa.array([raw]), common)[0].to_pylist() == [want]


def test_other_capitalised_words_stay(common):
    assert mask(pa.array(NO_PERSON), common)[0].to_pylist() == NO_PERSON


def test_all_of_the_above_with_a_vocabulary(common):
    texts = [*KEPT, *[f for f, _ in FOUND]]
    assert mask(pa.array(texts), common)[0].to_pylist() == [*KEPT, *[w for _, w in FOUND]]


def test_recall_of_names_on_no_list(common, monkeypatch):
    """Given and family names that the kernel doesn't know, in sentences of several kinds; no list of given names at all."""
    monkeypatch.setattr(K, "GIVEN", [])
    K._given.cache_clear(), K._triggers.cache_clear()
    given = "Darnell Priyanka Oluwaseun Brayden Siobhan Tyrone Lakshmi Kwabena Niamh Thandiwe Ekaterina Jamal Eilidh Rohan Nkechi Bartosz Aoife Dmytro Zainab Anjali Keisha Mateusz Chidi Farouk Ngozi Deepika".split()
    family = "Whitcombe Deshmukh Adeyemi Kowalczyk Gallagher Okonkwo Subramanian Mensah Ferguson Nkosi Petrova Gomez Johansson Iyer Abernathy Wisniewski O'Sullivan Kovalenko Hussain Fitzgerald Nakamura Lindqvist McAllister Yilmaz Szabo Delacroix".split()
    frames = [
        "I met {} yesterday at the bank.", "{} told me that rents are falling.", "You can reach {} tomorrow.", "Last week {} lost the job.", "I paid {} the deposit.", "My landlord is {}, avoid.", "Signed, {}",
        "Please ask {} in payroll.", "her name is {} and she left", "{} (someone@example.com) runs the shop", "My old boss {} said so.", "Contact: Dr. {} / 415-555-0123", "It was signed for by {}.", "My neighbor {} works nights.",
        "{}, who lives next door, sold the house.", "I asked {} about it.", "Mr. {} owes me money.", "Talked to my cousin {} about it.", "{} emailed the board.", "thanks to {} for the help", "Yours, {} 0161 496 0000",
    ]
    texts = [f.format(f"{g} {n}") for i, (g, n) in enumerate(zip(given, family)) for f in frames]
    names = [f"{g} {n}" for g, n in zip(given, family) for _ in frames]
    row, kind, a, b = scan(pa.array(texts), common)
    found = {(r, texts[r][x:y]) for r, k, x, y in zip(row.tolist(), kind.tolist(), a.tolist(), b.tolist()) if KINDS[k] == "name"}
    K._given.cache_clear(), K._triggers.cache_clear()
    recall = sum((i, n) in found for i, n in enumerate(names)) / len(names)
    print(f"recall {recall:.3f} of {len(names)}")
    assert recall >= 0.9
