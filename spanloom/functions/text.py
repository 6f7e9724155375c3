"""Column functions over text: normal form, tokens, overlap, source of a span, topics, tickers."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from the edges of a token.
EDGE = ".,;:!?'\"()[]{}-…"
# Quotes and dashes folded by the normal form, and what they become.
FOLD_FROM = "‘’‚‛“”„\"–—− "
FOLD_TO = "''''''''--- "
def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _table(pairs: dict[str, str]) -> str:
    """A lookup table as one string: plans stay small, and a lookup is one search in it."""
    return "\x01" + "\x01".join(f"{k}\x02{v}" for k, v in pairs.items()) + "\x01"


def _lookup(table: str | Column, key: Column) -> Column:
    """The table's value of ``key``; '' if it has none or the key is empty."""
    # behind the key, up to the next one; a key that isn't there leaves the table, which begins with a mark
    rest = F.call_function("substring_index", F.lit(table), F.concat(F.lit("\x01"), key, F.lit("\x02")), F.lit(-1))
    return F.substring_index(rest, "\x01", 1)


#: Names of character references, as the standard library lists them; some also count without a semicolon. One table per initial.
_INITIALS = "".join(sorted({n[0] for n in html5}))
_NAMES = "\x03".join(_table({n: v for n, v in html5.items() if n[0] == i}) for i in _INITIALS)
_SHORT = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# numbers 128 to 159 stand for the characters of an old code page where that defines them
_OLD_PAGE = [bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)]
_FOLDS = {chr(i): chr(i).casefold() for i in range(128, 0x1E944) if not 0xD800 <= i < 0xE000 and chr(i).casefold() != chr(i).lower()}


def _class(chars) -> str:
    """A character class of ranges: a class of single characters is tried one by one at every place of a text."""
    cps = set(map(ord, chars))
    begins, ends = sorted(c for c in cps if c - 1 not in cps), sorted(c for c in cps if c + 1 not in cps)
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(begins, ends)) + "]"


_FOLD_TABLE, _FOLD_CLASS = _table(_FOLDS), _class(_FOLDS)
#: All letters of that class lie in here.
_FOLD_RANGE = f"[{min(_FOLDS)}-{max(_FOLDS)}]"


def _references(pieces: Column) -> Column:
    """What stands for each text after an ampersand, the ampersand included.

    In steps of named parts, so that no part is written into the plan more than once.
    """
    heads = F.transform(
        pieces,
        lambda p: F.struct(
            p.alias("p"),
            F.regexp_extract(p, "^(#(?:[0-9]+|[xX][0-9a-fA-F]+);?)", 1).alias("number"),
            # the whole name, or the longest short one that the text begins with
            F.array(F.regexp_extract(p, "^([a-zA-Z][a-zA-Z0-9]{1,31};?)", 1), F.regexp_extract(p, f"^({_SHORT})", 1)).alias("names"),
        ),
    )
    # null where no name has that initial
    named = lambda k: _lookup(F.get(F.split(F.lit(_NAMES), "\x03"), F.instr(F.lit(_INITIALS), F.substring(k, 1, 1)) - 1), k)
    digits = lambda x: F.regexp_extract(x["number"], "^#[xX]?0*([0-9a-fA-F]+)", 1)
    big = lambda x: F.length(digits(x)) > 8
    is_hex = lambda x: F.lower(F.substring(x["number"], 2, 1)) == "x"
    code = lambda x: F.when(big(x), F.lit(0x110000)).otherwise(F.when(is_hex(x), F.conv(digits(x), 16, 10)).otherwise(digits(x)).cast("bigint"))
    found = F.transform(
        heads,
        lambda x: F.struct(
            x["p"].alias("p"),
            x["number"].alias("number"),
            F.when(x["number"] != "", code(x)).alias("code"),
            F.get(F.filter(F.transform(x["names"], lambda k: F.struct(k.alias("k"), named(k).alias("v"))), lambda h: (h["k"] != "") & (h["v"] != "")), F.lit(0)).alias("head"),
        ),
    )

    def result(x: Column) -> Column:
        c, after = x["code"], lambda head: F.substring(x["p"], F.length(head) + 1, F.length(x["p"]))
        lost = (c == 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF)
        none = c.between(1, 8) | c.between(14, 31) | (c == 11) | (c == 127) | c.between(0xFDD0, 0xFDEF) | (F.pmod(c, F.lit(0x10000)) >= 0xFFFE)
        old = F.get(F.array(*[F.lit(y) for y in _OLD_PAGE]), (c - 128).cast("int"))
        char = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        of_number = F.when(lost, "\ufffd").when(c.between(128, 159), old).when(none, "").otherwise(char)
        return F.when(x["number"] != "", F.concat(of_number, after(x["number"]))).when(x["head"].isNotNull(), F.concat(x["head"]["v"], after(x["head"]["k"]))).otherwise(F.concat(F.lit("&"), x["p"]))

    return F.transform(found, result)


def unescape(text: str | Column) -> Column:
    """Character references replaced: all names and numbers, with a semicolon or without where that counts."""
    c = _c(text)
    decoded = F.get(F.transform(F.array(F.split(c, "&", -1)), lambda x: F.concat(F.get(x, F.lit(0)), F.array_join(_references(F.slice(x, F.lit(2), F.size(x))), ""))), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def casefold(text: str | Column) -> Column:
    """Lower case that also unites what lower case keeps apart, such as sharp s and double s."""
    fold = lambda ch: F.coalesce(F.nullif(_lookup(_FOLD_TABLE, ch), F.lit("")), F.lower(ch))
    # the text is bound to a name, so that it is worked out once
    return F.get(F.transform(F.array(_c(text)), lambda x: F.when(x.rlike(_FOLD_RANGE) & x.rlike(_FOLD_CLASS), F.array_join(F.transform(F.split(x, ""), fold), "")).otherwise(F.lower(x))), F.lit(0))


def normalize(text: str | Column) -> Column:
    """Normal form for span matching; null and empty give ''.

    References are decoded, backslashes dropped, quotes, dashes and special blanks folded, blanks
    collapsed, ends trimmed and case folded. Built-in expressions only, so it works inside of
    lambdas; texts without references and rare letters take none of the longer ways.
    """
    c = unescape(F.coalesce(_c(text), F.lit("")))
    c = F.translate(F.replace(c, F.lit("\\"), F.lit("")), FOLD_FROM, FOLD_TO)
    c = F.replace(c, F.lit("…"), F.lit("..."))
    return casefold(F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")))


def span_in(span: str | Column, text: str | Column) -> Column:
    """Whether the span occurs in the text, both in normal form; false if either is null or empty."""
    s, t = _c(span), _c(text)
    return F.when((F.coalesce(s, F.lit("")) == "") | (F.coalesce(t, F.lit("")) == ""), False).otherwise(F.contains(normalize(t), normalize(s)))


def span_source(span: Column, comment: Column, parent: Column, post: Column) -> Column:
    """The first of comment, parent and post that holds the span; null if none does."""
    return F.when(span_in(span, comment), "comment").when(span_in(span, parent), "parent").when(span_in(span, post), "post")


def post_text(title: str | Column, selftext: str | Column) -> Column:
    """Title and self text of a post as one source text; null if both are empty."""
    parts = F.concat_ws(" \n ", F.nullif(_c(title), F.lit("")), F.nullif(_c(selftext), F.lit("")))
    return F.nullif(parts, F.lit(""))


def tokens(span: str | Column, edge: str | None = EDGE) -> Column:
    """Distinct tokens of a span in normal form; ``edge=None`` keeps punctuation at their edges."""
    words = F.split(normalize(span), " ")
    if edge:
        # btrim takes a set of characters, so tokens lose them from both ends
        words = F.transform(words, lambda w: F.btrim(w, F.lit(edge)))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def token_iou(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def token_containment(a: Column, b: Column) -> Column:
    """Shared tokens over the size of the smaller token array; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def span_iou(a: str | Column, b: str | Column) -> Column:
    return token_iou(tokens(a), tokens(b))


def span_containment(a: str | Column, b: str | Column) -> Column:
    return token_containment(tokens(a), tokens(b))


def strip_kind(ref: str | Column) -> Column:
    """What follows the first underscore, all of it without one, '' for null."""
    return F.regexp_replace(F.coalesce(_c(ref), F.lit("")), "^[^_]*_", "")


def locate(text: str | Column, span: str | Column) -> Column:
    """Start of the first exact occurrence, counted from 0; null if there is none or the span is empty."""
    at = F.instr(_c(text), _c(span))
    return F.when(F.coalesce(F.length(_c(span)), F.lit(0)) > 0, F.nullif(at, F.lit(0)) - 1)


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Characters between two spans; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), s2 - e1, s1 - e2)


def slug(model: str | Column) -> Column:
    return F.translate(_c(model), "/:", "__")


def half(cid: str | Column) -> Column:
    """Split half of an id: parity of its MD5."""
    return F.conv(F.substring(F.md5(_c(cid)), 32, 1), 16, 10).cast("int") % 2


def opener(cid: str | Column) -> Column:
    """Who opens a debate on an id: parity of its MD5 without the last byte."""
    return F.conv(F.substring(F.md5(_c(cid)), 30, 1), 16, 10).cast("int") % 2


def sha(text: str | Column) -> Column:
    return F.sha2(F.encode(_c(text), "UTF-8"), 256)


def text_pos(key: str | Column) -> Column:
    """A row position that doesn't depend on storage: 28 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(_c(key)), 1, 7), 16, 10).cast("bigint")


# Topics in matching order and the lower-case substrings that indicate them.
TOPICS = {
    "trade_tariffs": ("tariff", "trade war", "trade deal", "supply chain"),
    "monetary_policy": ("the fed", "federal reserve", "interest rate", "rate hike", "rate cut", "powell", "quantitative easing", "central bank"),
    "inflation": ("inflation", " cpi", "cost of living", "purchasing power"),
    "employment": ("unemployment", "layoff", "jobs report", "labor market", "wages", "minimum wage"),
    "growth_gdp": ("gdp", "recession", "economic growth", "productivity"),
    "fiscal_taxes": ("deficit", "national debt", "government spending", "stimulus", "tax cut", "taxes", "budget bill"),
    "energy": ("oil price", "gas price", "opec", "energy price", "crude oil"),
    "housing": ("housing", "mortgage", "home price", "real estate", "landlord", "rent is", "rent has"),
    "markets_themselves": ("stock market", "bubble", "market crash", "s&p", "nasdaq", "valuation", "bull market", "bear market"),
    "crypto": ("bitcoin", "crypto", "ethereum", "btc "),
    "corporate_earnings": ("earnings", "buyback", "profit margin", "quarterly report"),
    "inequality_distribution": ("inequality", "wealth gap", "billionaire", "top 1%", "wealth tax", "rich get richer"),
    "personal_finance": (
        "my savings", "my paycheck", "paycheck to paycheck", "student loan", "credit card debt", "emergency fund", "my 401k",
        "my retirement", "my salary", "my finances", "personal debt", "my credit score", "can't afford",
    ),
    "geopolitics": ("sanction", "ukraine", "geopolit", "election", " war "),
}
# Words and signs of strong feeling.
EMOTIVE = (
    "terrified", "scared", "afraid", "worried", "worry", "anxious", "panic", "fear", "angry", "furious", "outrage", "disgust", "insane",
    "ridiculous", "absurd", "criminal", "scam", "hate", "awful", "terrible", "horrible", "devastat", "depress", "hopeless", "doomed",
    "screwed", "cooked", "brutal", "excited", "thrilled", "amazing", "incredible", "euphori", "to the moon", "all in", "yolo",
    "unbelievable", "shocking", "stunned", "wtf", "wow", "damn", "holy", "crazy",
)
EMOJI = ("🚀", "📉", "📈", "😭", "🙄", "💀", "🤡", "😂", "🤦")


def _has_any(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(text, F.lit(n))
    return out


def topics(body: str | Column) -> Column:
    """All topics that a text mentions, in matching order."""
    low = F.lower(_c(body))
    return F.array_compact(F.array(*[F.when(_has_any(low, words), t) for t, words in TOPICS.items()]))


def topic(body: str | Column) -> Column:
    """The first topic that a text mentions; null if none."""
    low, out = F.lower(_c(body)), None
    for t, words in TOPICS.items():
        out = F.when(_has_any(low, words), t) if out is None else out.when(_has_any(low, words), t)
    return out


def emotive_score(body: str | Column) -> Column:
    """Emotive words, up to two exclamation marks, an emoji and a shouted word, one point each."""
    b = _c(body)
    low = F.lower(b)
    words = F.lit(0)
    for w in EMOTIVE:
        words = words + F.contains(low, F.lit(w)).cast("int")
    marks = F.least(F.lit(2), F.length(b) - F.length(F.replace(b, F.lit("!"), F.lit(""))))
    shout = F.exists(F.split(b, r"(?U)\s+"), lambda t: (F.length(t) > 3) & (t == F.upper(t)) & (t != F.lower(t)))
    return words + marks + _has_any(b, EMOJI).cast("int") + shout.cast("int")


# Firm names of each ticker; letters only, matched whole and in any case.
TICKERS = {
    "AAPL": ("apple",), "MSFT": ("microsoft",), "GOOGL": ("alphabet", "google"), "AMZN": ("amazon",), "NVDA": ("nvidia",), "META": ("facebook", "meta"),
    "TSLA": ("tesla",), "NFLX": ("netflix",), "AMD": ("amd",), "INTC": ("intel",), "CRM": ("salesforce",), "ORCL": ("oracle",), "ADBE": ("adobe",),
    "CSCO": ("cisco",), "QCOM": ("qualcomm",), "AVGO": ("broadcom",), "IBM": ("ibm",), "PYPL": ("paypal",), "SHOP": ("shopify",), "UBER": ("uber",),
    "ABNB": ("airbnb",), "COIN": ("coinbase",), "HOOD": ("robinhood",), "PLTR": ("palantir",), "SNOW": ("snowflake",), "ROKU": ("roku",), "DIS": ("disney",),
    "BA": ("boeing",), "NIO": ("nio",), "RIVN": ("rivian",), "LCID": ("lucid motors",), "GME": ("gamestop",), "AMC": ("amc",), "BABA": ("alibaba",),
    "JPM": ("jpmorgan", "jp morgan"), "GS": ("goldman sachs",), "KO": ("coca-cola", "coca cola"), "PEP": ("pepsi",), "WMT": ("walmart",), "COST": ("costco",),
    "MCD": ("mcdonald",), "SBUX": ("starbucks",), "NKE": ("nike",), "XOM": ("exxon",), "CVX": ("chevron",), "PFE": ("pfizer",), "MRNA": ("moderna",),
    "F": ("ford motor",), "GM": ("general motors",), "BAC": ("bank of america",), "SPY": ("s&p 500", "s&p500", "sp500", "the s&p"), "QQQ": ("nasdaq 100",),
    "VTI": ("total stock market",), "ARKK": ("ark innovation", "arkk"),
}


def tickers(body: str | Column, universe: dict[str, tuple[str, ...]] = TICKERS) -> Column:
    """Sorted distinct tickers named in a text, by a firm's name or by a cashtag of the universe."""
    b = _c(body)
    names = {n: t for t, ns in universe.items() for n in ns}
    alternatives = "|".join(sorted(names, key=lambda n: (-len(n), n)))
    lookup = F.create_map(*[F.lit(x) for n, t in names.items() for x in (n, t)])
    by_name = F.transform(F.regexp_extract_all(F.lower(b), F.lit(rf"\b({alternatives})\b"), F.lit(1)), lambda n: lookup[n])
    tags = F.filter(F.regexp_extract_all(b, F.lit(r"\$([A-Z]{1,5})\b"), F.lit(1)), lambda t: t.isin(*universe))
    return F.array_sort(F.array_distinct(F.array_union(F.coalesce(by_name, F.array()), F.coalesce(tags, F.array()))))


def verdict(content: str | Column) -> Column:
    """The verdict of the last verdict line of a debate turn, upper case; UNSURE without one."""
    found = F.regexp_extract_all(F.coalesce(_c(content), F.lit("")), F.lit(r"(?im)^\s*VERDICT:\s*(A|B|NEUTRAL|CUSTOM|UNSURE)\b"), F.lit(1))
    return F.upper(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("UNSURE")))


def custom_block(content: str | Column) -> Column:
    """The last proposed pair list of a debate turn with blanks collapsed; null without one."""
    # what stands between verdict lines, from its first pair on
    parts = F.transform(F.split(F.coalesce(_c(content), F.lit("")), r"\n[ \t]*VERDICT:"), lambda x: F.regexp_extract(x, r"(?s)(?:^|\n)(- emotion:.*)", 1))
    return F.trim(F.regexp_replace(F.try_element_at(F.filter(parts, lambda x: x != ""), F.lit(-1)), r"\s+", " "))


def in_first_order(items: Column) -> Column:
    """The distinct items of an array, each at its first place."""
    return F.array_distinct(items)


def questions(content: str | Column) -> Column:
    """The questions that a debate turn asks both, in their order."""
    found = F.regexp_extract_all(F.coalesce(_c(content), F.lit("")), F.lit(r"(?im)^[ \t]*QUESTION FOR A (?:&|AND) B:[ \t]*(\S.*?)[ \t]*$"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def render_item(title: Column, selftext: Column, parent: Column, body: Column) -> Column:
    """An item as labelled sections joined by blank lines; empty sections but the title are left out."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("POST TITLE: "), F.coalesce(given(title), F.lit("(unavailable)"))),
        F.concat(F.lit("POST BODY: "), given(selftext)),
        F.concat(F.lit("PARENT COMMENT: "), given(parent)),
        F.concat(F.lit("COMMENT (annotate this): "), body),
    )


def valence(emotion: Column, intensity: Column) -> Column:
    """Sign of the emotion times intensity; unknown emotions have none."""
    from ..schema import VALENCE

    sign = F.coalesce(F.create_map(*[F.lit(x) for kv in VALENCE.items() for x in kv])[emotion], F.lit(0))
    return F.coalesce(sign * F.coalesce(intensity, F.lit(0.0)), F.lit(0.0))


def week_end(day: str | Column) -> Column:
    """The Friday that ends the week of a date: Saturday to Friday."""
    return F.next_day(F.date_sub(F.to_date(_c(day)), 1), "FRI")


def week_start(day: str | Column) -> Column:
    """The Saturday that begins that week."""
    return F.date_sub(week_end(day), 6)
