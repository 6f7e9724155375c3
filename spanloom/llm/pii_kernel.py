"""Detection of personal information in a batch of texts, by offset-preserving transducers.

All texts of a batch are joined to one string. Each transducer rewrites it and keeps, for every
character of its output, the range of source characters it stands for:

1. glyphs: look-alike letters, full-width forms, invisible characters (``glyphs.fold``), accents;
2. entities: ``&#64;`` and the like;
3. digits spelled as words, in runs long enough for a number;
4. ``at`` and ``dot`` disguises of mail addresses.

The detectors run on the last output, and what they find is mapped back through the ranges, so the
placeholders replace exactly the disguised source text and nothing beside it.
"""

from __future__ import annotations

import base64
import bisect
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa

from .arrow_text import to_code_points
from .glyphs import fold

KINDS = ("email", "phone", "id_number", "address", "name")
SEPARATOR = ""

# Given names in use in several countries; words that are also common nouns are left out.
GIVEN = (
    "aaron adam ahmed aisha alan albert alice amara amelia amir ana anders andrew angela anna anne anton antonio arjun "
    "barbara bea benjamin callum camila carlos carmen caroline catherine chen chloe christopher clara daniel david devin "
    "diana diego dimitri donald elena eleanor elias elizabeth emily emma erik eva fatima felix gabriel george greta hannah "
    "hans hassan helena helen henrik hiroshi hugo ibrahim ingrid isabel ivan jamal james jane javier jean jennifer jessica "
    "john jonah jonas jorge jose joseph juan julia karen karl katherine keiko kevin khalid klaus lars laura leon leonardo "
    "linda louise lucas lucia luis lukas mahmoud manuel marco margaret maria marie marta martha martin mary mateo matthew "
    "maya mehmet mei michael michelle miguel mikhail milan mohamed nadia naomi nathan nia nicolas nina noah noor olga "
    "oliver olivia omar oscar pablo patricia patrick paul paula pedro percy peter petra philip pierre priya rachel rafael "
    "raj rania raul ravi rebecca ricardo richard robert roberto rosa ruth samir samuel sandra sara sarah sean sergei simone "
    "sofia soren stefan stella stephen susan svetlana sven takeshi tamara tariq teresa thomas tobias tomas tomasz ursula "
    "valentina vera veronica victor vikram vincent viktor vladimir wanda wei werner william wolfgang yara yasmin "
    "yuki yusuf zara zeynep zoe"
).split()

# Words that follow a given name without being a family name, and words of places, firms and terms.
NOT_FAMILY = frozenset(
    "a about after again all also always am an and are as asked at be because been before but by called calls came can could did does "
    "doing for from gave get gets got had has have he her here him his how i if in into is it its just knows last left likes lives lost "
    "made make may me met might moved must my never not now of off on once only or our out over paid runs said saw says sent she should so "
    "sold some spoke still than that the their them then there they thinks this to told took tells used wants was we went were what when "
    "where which while who will with wont works would wrote you your yours too very "
    "street st road rd avenue ave boulevard blvd lane drive court square bank holdings partners curve rule valley act plan effect "
    "law model index university institute inc corp ltd llc group award prize disease "
    "decade age".split()
)
# Persons of public life and of the history of economics; who bears such a name isn't taken for a private person.
PUBLIC = frozenset(
    name.strip()
    for name in (
        "adam smith, karl marx, david ricardo, john keynes, john maynard keynes, friedrich hayek, milton friedman, joseph schumpeter, thomas malthus, john stuart mill, alfred marshall, "
        "irving fisher, paul samuelson, robert solow, gary becker, hyman minsky, thorstein veblen, ludwig von mises, murray rothbard, henry george, thomas piketty, joseph stiglitz, paul krugman, "
        "amartya sen, elinor ostrom, daniel kahneman, amos tversky, robert shiller, eugene fama, nouriel roubini, larry summers, lawrence summers, robert reich, robert lucas, stephanie kelton, "
        "alan greenspan, paul volcker, ben bernanke, janet yellen, jerome powell, arthur burns, christine lagarde, mario draghi, mervyn king, mark carney, andrew bailey, neel kashkari, jim cramer, "
        "warren buffett, charlie munger, george soros, ray dalio, carl icahn, michael burry, peter lynch, cathie wood, jamie dimon, bernie madoff, bill ackman, jack bogle, benjamin graham, "
        "elon musk, jeff bezos, bill gates, steve jobs, mark zuckerberg, peter thiel, tim cook, satya nadella, sundar pichai, sam altman, henry ford, andrew carnegie, john rockefeller, "
        "donald trump, joe biden, barack obama, george bush, george washington, abraham lincoln, thomas jefferson, alexander hamilton, franklin roosevelt, theodore roosevelt, ronald reagan, jimmy carter, "
        "richard nixon, bill clinton, hillary clinton, kamala harris, bernie sanders, elizabeth warren, nancy pelosi, mitch mcconnell, ron paul, rand paul, paul ryan, mitt romney, john mccain, "
        "margaret thatcher, winston churchill, tony blair, gordon brown, david cameron, theresa may, boris johnson, liz truss, rishi sunak, keir starmer, angela merkel, olaf scholz, emmanuel macron, "
        "vladimir putin, volodymyr zelensky, xi jinping, mao zedong, deng xiaoping, narendra modi, shinzo abe, justin trudeau, fidel castro, hugo chavez, joseph stalin, vladimir lenin, adolf hitler, "
        "martin luther, isaac newton, albert einstein, charles darwin, john locke, jean jacques rousseau, immanuel kant, friedrich nietzsche, max weber, ayn rand, george orwell, upton sinclair"
    ).split(",")
)
# Words that stand capitalised without being names of persons.
CAPITAL = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december christmas easter "
    "american british english french german italian spanish russian chinese japanese indian european african asian canadian mexican dutch swiss swedish greek turkish polish "
    "america britain england scotland wales ireland france germany italy spain russia china japan india europe africa asia canada mexico london paris berlin york brussels "
    "goldman sachs wells fargo morgan chase stanley lehman barclays deutsche standard fitch moody google facebook amazon microsoft congress senate democrat republican reddit".split()
)
# What one is to another.
RELATION = "boss landlord landlady neighbor neighbour friend buddy colleague coworker co-worker manager supervisor cousin brother sister wife husband uncle aunt doctor dentist lawyer accountant teacher roommate tenant son daughter mother father mom mum dad partner fiance fiancee girlfriend boyfriend nephew niece grandmother grandfather mate agent broker nurse therapist"
# Words before a person's name, and words after one.
CUES = rf"(?:signed|is|contact|ask|mention|by|gru(?:ss|ß)|regards|sincerely|named|called|name|from|mit|atte|mr|mrs|ms|dr|prof|sra?|herr|frau|mme|{RELATION.replace(' ', '|')})"
BEFORE_PERSON = frozenset(
    f"{RELATION} met meet meeting know knew knows married dated hired hire told tell asked ask emailed email e-mail called call phoned phone texted text contact contacted reach reached thank thanked thanks "
    "mention mentioned signed sign regards sincerely cheers best named name is by paid pay owe owed helped help visited visit interviewed with to dear hi hello hey attn attention mr mrs ms miss dr prof sir madam cc "
    "gruß gruss gruße gruesse herr frau senor senora madame monsieur saw see sued reported".split()
)
AFTER_PERSON = frozenset(
    "said says told tells asked asks wrote writes emailed emails called calls texted replied answered works worked lives lived moved lost thinks thought knows knew owns owned rents rented paid pays died married joined "
    "retired quit drove drives came went goes met helped helps insists swears teaches taught signed reckons believes got gets earns earned wants wanted studies studied grew turned hates loves likes runs ran yesterday who whose whom and or has had was is "
    "tomorrow today tonight again about at from in on instead please".split()
)
# The words above that stand beside places and firms as well: these need the given name on the list or a second sign.
WEAK = frozenset("with to is by see saw in at on from and or has had was is about called reported said says who".split())

_NUM = {"oh": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORDNUM = "|".join(_NUM)
SPELLED = re.compile(rf"(?:{_WORDNUM})(?:[ ,.-]{{1,2}}(?:{_WORDNUM}|\d{{1,4}})(?![a-z])){{5,}}")
SPELLED_PART = re.compile(rf"{_WORDNUM}|\d+")
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|commat|period|nbsp|amp|lt|gt|hyphen);")
_AT = r"(?: ?[\[({<] ?at ?[\])}>] ?| at | @ |@)"
_DOT = r"(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)"
DISGUISED = re.compile(rf"[a-z0-9][a-z0-9._%+-]*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,24}}(?![a-z0-9-])")
AT_PART, DOT_PART = re.compile(_AT), re.compile(r" ?[\[({<] ?dot ?[\])}>] ?| dot ")
MAIL_LOCAL = re.compile(r"[a-z0-9][a-z0-9._%+-]{0,63}$")
MAIL_DOMAIN = re.compile(r"@(?:[a-z0-9-]+\.)+[a-z]{2,24}(?![a-z0-9-])")

DIGIT_RUN = re.compile(r"\d[\d ().+-]{5,}\d")
PHONE = re.compile(r"(?<![a-z0-9.,$/-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?)?\d(?:[ .-]?\d){5,13}(?:,? ?(?:ext|x)\.? ?\d{1,5})?(?![\w%]|[.-]\d)")
EXTENSION = re.compile(r",? ?(?:ext|x)\.? ?\d{1,5}$")
NANP = re.compile(r"(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-]?)[2-9]\d\d[ .-]?\d{4}")
ABROAD = re.compile(r"(?:\+|00)[1-9]\d{0,2}(?:[ .-]?\(?\d{1,5}\)?)(?:[ .-]?\d{2,8}){1,4}")
NATIONAL = re.compile(r"\(0\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|0\d{2,4}[ .-]?\d{3}[ .-]?\d{3,4}|0\d{4}[ -]\d{6}|0\d{9,10}")
QUANTITY = re.compile(r" ?(?:shares|units|jobs|barrels|tonnes|dollars|euros|people|views|votes|bps)\b")

SSN_OR_LICENCE = re.compile(r"\d{3}-(?:\d{2}|\d{4})-\d{4}(?![\w-])")
NINO = re.compile(r"\d{2} ?\d{2} ?\d{2} ?[a-d](?![a-z0-9])")
NINO_HEAD = re.compile(r"(?:^|[^a-z0-9])([a-z]{2} ?)$")
# Endings of mail domains longer than two letters, and words that aren't mailboxes.
ENDINGS = frozenset("com org net edu gov mil int info biz name dev app xyz online site shop cloud example test invalid localhost".split())
NO_MAILBOX = NOT_FAMILY | frozenset("look looking found find see me us them arrive arrived meet stay live sits hosted available site page website".split())
# What an identity number is called.
ID_CUES = (
    "ssn", "social security", "tax id", "tax number", "tax no", "taxpayer", "itin", "national insurance", "ni number", "ni no", "nino", "passport", "passnummer",
    "pasaporte", "iban", "social insurance number", "sin", "sin number", "driver's license", "drivers license", "driver license", "driver's licence", "drivers licence", "driver licence", "driving licence", "driving license",
    "license number", "licence number", "license no", "licence no", "insurance number", "insurance no", "steuer-id", "steuerid", "dni", "nif",
)
ID_VALUE = re.compile(r"(?:[ :#]{1,2}(?:number|nummer|no\.?|nr\.?|id|is|was))*[ :#.]{1,3}(?P<v>[a-z]{0,2}[ -]?\d+(?:[ -]?\d+)*(?: ?[a-d](?![a-z]))?)(?![a-z0-9])")

PASSPORT_VALUE = re.compile(r"(?:[ :#]{1,2}(?:number|nummer|no\.?|nr\.?|id|is|was))*[ :#.]{1,3}(?P<v>(?=[a-z0-9]*\d[a-z0-9]*\d[a-z0-9]*\d)[a-z0-9]{7,10})(?![a-z0-9-])")
IBAN = re.compile(r"\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,4})?(?![a-z0-9])")
IBAN_HEAD = re.compile(r"(?:^|[^a-z0-9])[a-z]{2}$")

# Further kinds of streets, whose names are common nouns: they need title case.
SOFT_SUFFIX = ("gardens", "grove", "mews", "row", "walk", "hill", "rise", "park", "green", "view", "heights", "circle", "trail", "quay", "wharf", "promenade", "crossing", "meadows")
_SUFFIX = r"(?:gardens|grove|mews|row|walk|hill|rise|park|green|view|heights|circle|trail|quay|wharf|promenade|crossing|meadows|street|str|st|avenue|ave|boulevard|blvd|road|rd|lane|ln|drive|dr|court|ct|place|pl|square|sq|terrace|way|crescent|close|parkway|pkwy|highway|hwy)"
_TAIL = r"(?:,? ?(?:apt|apartment|unit|suite|ste|flat|no|#)\.? ?[0-9]{1,5}[a-z]?)?"
_CITY = r"(?:, ?[a-z][a-z'-]+(?: [a-z][a-z'-]+){0,2}?(?: \d{5})?(?=[.,;:!?)/]|$| and | or |\n|" + SEPARATOR + r"| signed))?"
NUMBERED = re.compile(rf"\d{{1,5}}[a-z]?,? (?:(?:n|s|e|w|ne|nw|se|sw|north|south|east|west)\.? )?(?P<name>(?:[a-z][a-z'-]+ ){{1,3}}?)(?P<suffix>{_SUFFIX})(?![a-z])\.?{_TAIL}{_CITY}")
STRASSE = re.compile(r"(?:sse|\xdfe|\.) ?\d{1,4}[a-z]?(?![\w])(?:, ?(?:\d{5} )?[a-z][a-z'-]+(?: [a-z][a-z'-]+)?(?=[.,;:!?)/]|$| and | or |\n|" + SEPARATOR + r"))?")
STRASSE_HEAD = re.compile(r"(?:^|[^a-z])([a-z]{3,}(?: stra| str|stra|str))$")
CALLE = re.compile(r"(?:de la |de |del |du )?[a-z][a-z'-]+(?: [a-z][a-z'-]+)?,? \d{1,4}(?![\w])" + _CITY)
# Words before the name of a street.
STREET_WORDS = ("calle ", "avenida ", "plaza ", "carrer ", "via ", "viale ", "rue ")
BOX = re.compile(r"(?<![a-z])p\.? ?o\.? ?box \d{1,6}(?![\w])" + _CITY)
FINANCE_STREETS = frozenset({"wall", "main", "broad", "high", "fleet", "bond", "threadneedle", "lombard", "street"})
GO_ON = frozenset("and or in near by is was since until at where but so because with while before after to from for if as when who which then that now please today avoid".split())
NOT_IN_STREET = frozenset("the a an of to in on for and or is are was were by at per from this that than when with months month weeks years year days percent basis points times more out their his her no not now its one two".split())


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """One-to-one table: lower case without accents, where both keep the length."""
    t = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x41, 0x2000):
        ch = chr(cp)
        base = {"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d"}.get(ch) or unicodedata.normalize("NFD", ch)[0]
        low = base.lower()
        if len(low) == 1:
            t[cp] = ord(low)
    t[0x2019] = t[0x2018] = 0x27
    t[0x09] = 0x20
    return t


@lru_cache(maxsize=1)
def _triggers():
    """One automaton over everything rare that a detector starts from: (what, length)."""
    import ahocorasick

    words: dict[str, list[str]] = {}
    put = lambda what, *ws: [words.setdefault(w, []).append(what) for w in ws]
    put("given", *GIVEN)
    put("spelled", *(f"{a}{sep}{b}" for a in _NUM for b in _NUM for sep in " -"))
    put("disguise", " dot ", "(dot", "[dot", "{dot", "( dot", "[ dot", "(at)", "[at]", "{at}", "( at )", "[ at ]", " @ ", "<at>", "<dot>")
    put("mail", "@")
    put("id", *ID_CUES)
    put("strasse", "stra", "str.")
    put("calle", *STREET_WORDS)
    put("box", "box ")
    put("cue", "signed", "name is", "contact", "gruss", "gruß", "regards", "sincerely", "mr. ", "mrs. ", "ms. ", "dr. ", "prof. ", "mr ", "mrs ", "ms ", "dr ", "prof ")
    put("small", "ask ", "asked ", "mention ", "mentioned ", "tell ", "told ", "met ", "emailed ", "texted ")
    put("cue", *(f"{who}{how}" for who in RELATION.split() for how in ("", " is", " was", " named")))
    auto = ahocorasick.Automaton()
    for w, whats in words.items():
        auto.add_word(w, (tuple(whats), len(w)))
    auto.make_automaton()
    return auto


def triggers(low: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of all triggers in ``low`` by what they start."""
    out: dict[str, list[tuple[int, int]]] = {}
    for last, (whats, n) in _triggers().iter(low):
        for what in whats:
            out.setdefault(what, []).append((last + 1 - n, last + 1))
    return out


class Tape:
    """A text with, for each character, the source range it stands for."""

    def __init__(self, text: str, begin: np.ndarray, end: np.ndarray):
        self.text, self.begin, self.end = text, begin, end

    def edit(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace ranges (ascending, disjoint); every new character stands for its whole range."""
        if not edits:
            return self
        text, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            begin += [self.begin[at:a], np.full(len(new), self.begin[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), np.concatenate([*begin, self.begin[at:]]), np.concatenate([*end, self.end[at:]]))


def _spelled(low: str, at: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    out, done = [], 0
    for a, _ in at:
        if a < done or (a and low[a - 1].isalpha()):
            continue
        m = SPELLED.match(low, a)
        if not m:
            continue
        parts = SPELLED_PART.findall(m[0])
        digits = "".join(_NUM.get(p, p) for p in parts)
        if sum(p in _NUM for p in parts) >= 3 and len(digits) >= 7:
            if len(digits) == 10:
                digits = f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"
            out.append((m.start(), m.end(), digits))
        done = m.end()
    return out


def _disguises(low: str, at: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    out, done = [], 0
    for first, last in at:
        if first < done:
            continue
        at_pos, stop = max(done, first - 100), min(len(low), last + 200)
        while (m := DISGUISED.search(low, at_pos, stop)) and m.start() <= first:
            s = m[0]
            sign = AT_PART.search(s)
            if m.end() <= first:
                at_pos = m.start() + sign.end()
                continue
            if sign[0] == " at ":
                # plain words: only with a spelled dot, a known ending, and no ordinary word before;
                # else the address may begin behind them
                end = s[max(s.rfind("."), s.rfind(" "), s.rfind(")"), s.rfind("]")) + 1 :]
                if not DOT_PART.search(s, sign.end()) or (len(end) > 2 and end not in ENDINGS) or s[: sign.start()] in NO_MAILBOX:
                    at_pos = m.start() + sign.end()
                    continue
            out.append((m.start() + sign.start(), m.start() + sign.end(), "@"))
            out += [(m.start() + x.start(), m.start() + x.end(), ".") for x in DOT_PART.finditer(s, sign.end())]
            done = m.end()
            break
    return out


def _mails(low: str, at: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for a, _ in at:
        if low[a - 1 : a].isalnum() or low[a - 1 : a] in ("_", "+", "-", "%", "."):
            head = MAIL_LOCAL.search(low, max(0, a - 65), a)
            tail = MAIL_DOMAIN.match(low, a)
            if head and tail:
                yield head.start(), tail.end()


def _phones(low: str) -> Iterator[tuple[int, int]]:
    done = 0
    for run in DIGIT_RUN.finditer(low):
        for m in PHONE.finditer(low, max(done, run.start() - 6), min(len(low), run.end() + 40)):
            if m.start() >= run.end():
                break
            core = EXTENSION.sub("", m[0])
            ok = NANP.fullmatch(core) or ABROAD.fullmatch(core) or NATIONAL.fullmatch(core)
            if ok and not QUANTITY.match(low, m.end()) and sum(c.isdigit() for c in core) <= 15:
                done = m.end()
                yield m.span()


def _iban_holds(s: str) -> bool:
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ids(low: str, text: str, at: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for m in SSN_OR_LICENCE.finditer(low):
        a, before = m.start(), low[max(0, m.start() - 2) : m.start()]
        if m.end() - a == 11:
            if not (before[-1:].isalnum() or before[-1:] in ("-", "_")):
                yield m.span()
        elif before[-1:].isalpha() and not before[:-1].isalnum():
            yield a - 1, m.end()
    for m in NINO.finditer(low):
        if head := NINO_HEAD.search(low, max(0, m.start() - 4), m.start()):
            yield head.start(1), m.end()
    for a, b in at:
        if a and low[a - 1].isalpha():
            continue
        if low[a:b].startswith("sin") and not text[a : a + 3].isupper():
            continue
        m = ID_VALUE.match(low, b)
        if m and sum(c.isdigit() for c in m["v"]) >= 6:
            yield m.span("v")
        elif low[a:b] in ("passport", "passnummer", "pasaporte") and (m := PASSPORT_VALUE.match(low, b)):
            yield m.span("v")
    for m in IBAN.finditer(low):
        a = m.start() - 2
        if a < 0 or not low[a].isalpha() or not IBAN_HEAD.search(low, max(0, a - 1), m.start()):
            continue
        # the longest piece whose check digits are right, as a word may follow
        for end in range(m.end(), a + 15, -1):
            if (end == len(low) or not low[end].isalnum()) and _iban_holds(low[a:end].replace(" ", "")):
                yield a, end
                break


_NEXT_WORD = re.compile(r" ([a-z]+)")


def _trim_city(a: int, street_end: int, end: int, text: str) -> tuple[int, int]:
    """Leave a following clause out that was taken for a place: one in lower case after a street in title case."""
    rest = text[street_end:end]
    at = rest.rfind(", ")
    if at >= 0 and rest[at + 2 : at + 3].islower() and any(c.isupper() for c in text[a:street_end]):
        return a, street_end + at
    return a, end


def _addresses(low: str, text: str, at: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    for m in NUMBERED.finditer(low):
        before = low[m.start() - 1 : m.start()]
        if before.isalnum() or (before and before in "_.$,/-"):
            continue
        words = m["name"].split()
        if any(w in NOT_IN_STREET for w in words):
            continue
        if m["suffix"] in SOFT_SUFFIX and not all(w[:1].isupper() and w[1:2].islower() for w in text[m.start("name") : m.end("suffix")].split()):
            continue
        bare = m.end() <= m.end("suffix") + 1
        nxt = _NEXT_WORD.match(low, m.end())
        if nxt and nxt[1] not in GO_ON:
            shout = text[m.start("suffix") : m.end("suffix")].isupper()
            if text[nxt.start(1)].islower() or shout:
                continue
        if bare and words[-1] in FINANCE_STREETS and m["suffix"] in ("street", "st") and low[m.end() : m.end() + 1] not in (",", "."):
            continue
        yield _trim_city(m.start(), m.end("suffix"), m.end(), text)
    for a, b in at.get("strasse", ()):
        head = STRASSE_HEAD.search(low, max(0, a - 40), min(b, a + 4) if low[a : a + 4] == "stra" else a + 3)
        tail = STRASSE.match(low, a + 4 if low[a : a + 4] == "stra" else a + 3)
        if head and tail:
            yield _trim_city(head.start(1), tail.start() + 3, tail.end(), text)
    for a, b in at.get("calle", ()):
        if not (a and low[a - 1].isalpha()) and (m := CALLE.match(low, b)):
            yield _trim_city(a, b, m.end(), text)
    for a, b in at.get("box", ()):
        if m := BOX.search(low, max(0, a - 8), b + 80) if low[b : b + 1].isdigit() else None:
            if m.start() <= a < m.end():
                yield _trim_city(m.start(), b, m.end(), text)


_FAMILY = re.compile(r" (?:[a-z]\.? )?([a-z][a-z']+(?:-[a-z][a-z']+)*)")
_BEFORE = re.compile(rf"(?:^|[\n{SEPARATOR}]|(?<![a-z]){CUES}[,:.]?) *$")
_CUE_WORD = re.compile(CUES)
_REVERSED = re.compile(r"([a-z][a-z']+(?:-[a-z][a-z']+)*), $")
_GLUE = frozenset("@_+-./&#$")
CUED = re.compile(r"[,:.]? ?(?:(?:mr|mrs|ms|dr|prof)\. )?([a-z][a-z'-]+) (?:[a-z]\. )?([a-z][a-z']+(?:-[a-z][a-z']+)*)(?![\w@-])")


def _case(s: str) -> str:
    if s.isupper():
        return "upper"
    return "title" if s[0].isupper() and not s[1:].isupper() else "lower"


def _family_follows(low: str, text: str, at: int) -> bool:
    """Whether a family name comes after the two listed names that end at ``at``."""
    m = _FAMILY.match(low, at)
    return bool(m) and len(m[1]) > 2 and m[1] not in NOT_FAMILY and text[m.start(1)].isupper()


def _names_in(low: str, text: str, at: dict[str, list[tuple[int, int]]], common: frozenset = frozenset()) -> Iterator[tuple[int, int]]:
    for a, b in at.get("given", ()):
        prev, nxt = low[a - 1] if a else "", low[b : b + 1]
        if prev.isalnum() or prev in _GLUE or nxt.isalnum() or nxt in ("@", "_", "+"):
            continue
        given = _case(text[a:b])
        if m := _REVERSED.search(low, max(0, a - 60), a):
            fam = m[1]
            if len(fam) > 2 and fam not in NOT_FAMILY and fam not in common and not _CUE_WORD.fullmatch(fam) and _case(text[m.start(1) : m.end(1)]) == given and (_BEFORE.search(low, max(0, m.start() - 24), m.start()) or low.startswith((" (", " /"), b)):
                yield m.start(), b
                continue
        if nxt == " " and (m := _FAMILY.match(low, b)):
            fam = m[1]
            end = m.end()
            after = low[end : end + 1]
            shape = _case(text[m.start(1) : m.end(1)])
            if fam in _given() and not (given == shape == "title" and not _family_follows(low, text, end)):
                continue
            if len(fam) > 2 and fam not in NOT_FAMILY and after not in ("@", "_", "+"):
                same = shape == given or (given == "title" and shape == "upper")
                if same and given != "lower":
                    yield a, end
                    continue
                if same and (_BEFORE.search(low, max(0, a - 24), a) or after in ("", "(", ",", ".", "/", "\n", SEPARATOR) or low.startswith(" (", end)):
                    yield a, end
                    continue
    for a, b in at.get("cue", ()):
        if (a and low[a - 1].isalnum()) or not (m := CUED.match(low, b)):
            continue
        g, f = m[1], m[2]
        if g in common or f in common or g in CAPITAL or f in CAPITAL:
            continue
        if len(g) > 1 and len(f) > 2 and g not in NOT_FAMILY and f not in NOT_FAMILY and text[m.start(1)].isupper() and text[m.start(2)].isupper():
            if not text[m.start(1) : m.end(2)].isupper() and m[0].find("\n") < 0:
                yield m.start(1), m.end(2)


# Letters by case as far as one class can say it; patterns begin with a class, so that the search skips what is in none.
_UP, _LOW = "A-Z\xc0-\xd6\xd8-\xde\u0100-\u024f", "a-z\xdf-\xf6\xf8-\xff\u0100-\u024f"
_TITLE = rf"[{_UP}](?:'[{_UP}])?[{_LOW}]+(?:[-'][{_UP}{_LOW}]+)*(?:(?<=Mc)[{_UP}{_LOW}]+|(?<=Mac)[{_UP}{_LOW}]+)?"
_PARTICLE = r"(?:(?:de|da|del|della|di|dos|du|la|le|van|von|der|den|bin|al|el|ter) ){1,3}"
_END = r"(?![\w@-]|\.\w)"
# capitalised words in a row, family name first (found from its comma), and words in capitals only
RUN = re.compile(rf"{_TITLE}(?: (?:{_PARTICLE})?(?:[{_UP}]\. )?{_TITLE}){{1,4}}{_END}")
COMMA_GIVEN = re.compile(rf", ({_TITLE}){_END}")
FAMILY_BEFORE = re.compile(rf"{_TITLE}$")
IN_CAPITALS = re.compile(rf"[{_UP}]{{4,}}(?:-[{_UP}]+)*(?=,? (?:[{_UP}]\. )?([{_UP}]{{4,}}(?:-[{_UP}]+)*){_END})")
_VOWEL = re.compile("[aeiouy]")
# small letters only between a cue and the end of a clause or a verb of persons
SMALL = re.compile(r"[,:.]? ?([a-z][a-z'-]{2,})(,?) (?:[a-z]\. )?([a-z][a-z'-]{3,})(?=[.,;:!?()/\n" + SEPARATOR + r"]|$| (?:said|says|told|wrote|asked|in|at|from|about|on)\b)")
_LAST_WORD = re.compile(r"([a-z][a-z'-]*)\.?([,:;!?]?)[ \n]+$")
_FIRST_WORD = re.compile(r"(,?) ([a-z]+)")
_DONE_BY = re.compile(r"(?:signed|written|sent|posted|hired|told|taught|owned|run|managed|called)(?: for| up| off)? by $")
_NAMED = re.compile(rf"(?:^|[^a-z])(?:signed|named|called|(?:{RELATION.replace(' ', '|')})(?:,| is| was| named)?)[,:]? ?$")
#: Characters between a name and other personal data beside it.
BESIDE = 8


def _shaped_names(low: str, text: str, common: frozenset, cues: list[tuple[int, int]], others: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Given and family name by shape and context, whether on a list or not.

    A candidate is a run of capitalised words that, less common words at its head, has two or three
    words which are no common words (``common`` holds those that a large corpus writes in small
    letters) and no known capitalised words of other kinds. Its neighbours decide: a relation, a title or
    a verb before it, a verb of persons after it, other personal data beside it (``others``), or nothing
    else in the text. Words that stand beside firms and places as well count only together with another sign. Words in capitals
    or in small letters need the same and a narrower shape.
    """
    begins, ends = sorted(a for a, _ in others), sorted(b for _, b in others)

    def rare(*words: str) -> bool:
        return not any(w in common or w in CAPITAL or w in NOT_FAMILY for w in words)

    def inside(a: int) -> bool:
        """Whether what begins at ``a`` is the rest of a longer word, handle or number."""
        return a > 0 and (low[a - 1].isalnum() or low[a - 1] in "_@#$/&.+-")

    def public(first: str, last: str) -> bool:
        return f"{first} {last}" in PUBLIC

    def signs(a: int, end: int, lead: str | None, given: str) -> bool:
        w = _LAST_WORD.search(low, max(0, a - 30), a)
        before = lead or (w[1] if w and w[2] in ("", ",", ":") else "")
        f = _FIRST_WORD.match(low, end)
        comma, after = (f[1], f[2]) if f else ("", "")
        if before == "the" or text[end + 1 : end + 2].isupper() and not comma and low[end : end + 1] == " " and not text[a:end].isupper():
            return False
        n = sum(2 - (x in WEAK) for x, known in ((before, BEFORE_PERSON), (after, AFTER_PERSON)) if x in known)
        if comma and after in ("who", "whose", "my", "our"):
            n += 2
        # a text that is nothing else, such as an author's name
        if low[a - 1 : a] in ("", SEPARATOR) and low[end : end + 1] in ("", SEPARATOR):
            n += 2
        if _DONE_BY.search(low, max(0, a - 24), a) or _NAMED.search(low, max(0, a - 24), a):
            n += 2
        i, j = bisect.bisect_left(begins, end), bisect.bisect_right(ends, a) - 1
        if (i < len(begins) and begins[i] - end <= BESIDE and SEPARATOR not in low[end : begins[i]]) or (j >= 0 and a - ends[j] <= BESIDE and SEPARATOR not in low[ends[j] : a]):
            n += 2
        return n >= 2 or (n == 1 and given in _given())

    for m in RUN.finditer(text):
        a, end = m.span()
        if inside(a):
            continue
        words = low[a:end].split(" ")
        # a sentence's first word, a greeting or a title is no part of the name
        lead = None
        while len(words) > 1 and (words[0] in common or words[0] in CAPITAL or words[0].rstrip(".") in BEFORE_PERSON):
            lead = words.pop(0)
            a += len(lead) + 1
        full = [w for w in words if not w.endswith(".") and len(w) > 1]
        capitals = sum(w[:1].isupper() for w in text[a:end].split(" ") if len(w) > 1 and not w.endswith("."))
        if not 2 <= capitals <= 3 or end - a > 60:
            continue
        own = [w for w, t in zip(low[a:end].split(" "), text[a:end].split(" ")) if t[:1].isupper() and len(w) > 1 and not w.endswith(".")]
        if rare(*own) and low[a:end] not in PUBLIC and not public(full[0], full[-1]) and signs(a, end, lead and lead.rstrip("."), full[0]):
            yield a, end
    for m in COMMA_GIVEN.finditer(text):
        f = FAMILY_BEFORE.search(text, max(0, m.start() - 40), m.start())
        if not f or inside(f.start()):
            continue
        family, given = low[f.start() : f.end()], low[m.start(1) : m.end(1)]
        if rare(family, given) and family not in BEFORE_PERSON and not public(given, family) and signs(f.start(), m.end(), None, given):
            yield f.start(), m.end()
    for m in IN_CAPITALS.finditer(text):
        one, two = low[m.start() : m.end()], low[m.start(1) : m.end(1)]
        if inside(m.start()) or not text[m.start() : m.end(1)].isupper():
            continue
        if rare(one, two) and one not in BEFORE_PERSON and not public(one, two) and _VOWEL.search(one) and _VOWEL.search(two) and signs(m.start(), m.end(1), None, one):
            yield m.start(), m.end(1)
    for a, b in cues:
        if a and low[a - 1].isalnum() or not (m := SMALL.match(low, b)):
            continue
        if text[m.start(1) : m.end()].islower() and rare(m[1], m[3]) and m[1] not in BEFORE_PERSON and m[3] not in AFTER_PERSON and not public(m[1], m[3]):
            yield m.start(1), m.end()


@lru_cache(maxsize=1)
def _given() -> frozenset:
    return frozenset(GIVEN)


def transduce(cps: np.ndarray, off: np.ndarray) -> tuple[Tape, str, dict[str, list[tuple[int, int]]]]:
    """The normalised tape over all texts of a batch, its lower-case, accent-free form and its triggers."""
    cps = np.where(cps == ord(SEPARATOR), 0x20, cps).astype(np.uint32)
    n = len(off) - 1
    # a separator after each text; its source range is empty
    sep_at = off[1:] + np.arange(n)
    joined = np.full(cps.size + n, ord(SEPARATOR), np.uint32)
    is_text = np.ones(joined.size, bool)
    is_text[sep_at] = False
    joined[is_text] = cps
    source = np.empty(joined.size, np.int64)
    source[is_text] = np.arange(cps.size)
    source[sep_at] = off[1:]
    folded, _, idx = fold(joined, np.array([0, joined.size]), True)
    begin = source[idx]
    end = begin + is_text[idx]
    tape = Tape(folded.astype("<u4").tobytes().decode("utf-32-le"), begin, end)
    lower = _lower(tape.text)
    edits = [(m.start(), m.end(), unescape(m[0])[:1] or " ") for m in ENTITY.finditer(lower)] if "&" in lower else []
    if edits:
        tape, lower = tape.edit(edits), _spliced(lower, [(a, b, _lower(new)) for a, b, new in edits])
    at = triggers(lower)
    for what, step in (("spelled", _spelled), ("disguise", _disguises)):
        if what in at and (edits := step(lower, at[what])):
            tape, lower, at = tape.edit(edits), _spliced(lower, edits), _moved(at, edits)
    return tape, lower, at


def _spliced(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for a, b, new in edits:
        out += [text[done:a], new]
        done = b
    return "".join([*out, text[done:]])


def _moved(at: dict[str, list[tuple[int, int]]], edits: list[tuple[int, int, str]]) -> dict[str, list[tuple[int, int]]]:
    """Triggers after edits whose new texts are digits, ``@`` and ``.``: those outside move along, each ``@`` is a new one."""
    begin, end = np.array([e[0] for e in edits]), np.array([e[1] for e in edits])
    shift = np.concatenate([[0], np.cumsum([len(new) - (b - a) for a, b, new in edits])])
    out = {}
    for what, spans in at.items():
        if not spans:
            continue
        a, b = np.array(spans).T
        i = np.searchsorted(begin, a, "right")
        kept = ((i == 0) | (end[np.maximum(i - 1, 0)] <= a)) & ((i == len(begin)) | (begin[np.minimum(i, len(begin) - 1)] >= b))
        out[what] = list(zip((a + shift[i])[kept].tolist(), (b + shift[i])[kept].tolist()))
    signs = [int(x + shift[k]) for k, (x, _, new) in enumerate(edits) if new == "@"]
    if signs:
        out["mail"] = sorted(out.get("mail", []) + [(x, x + 1) for x in signs])
    return out


def _lower(text: str) -> str:
    """Lower case without accents, of the same length."""
    if text.isascii():
        return text.lower().replace("\t", " ")
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = cps + ((cps >= 0x41) & (cps <= 0x5A)).astype(np.uint32) * np.uint32(32)
    out[out == 9] = 0x20
    high = np.flatnonzero(cps >= 0x80)
    out[high] = _plain()[cps[high]]
    return out.tobytes().decode("utf-32-le")


def find(cps: np.ndarray, off: np.ndarray, common: frozenset | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, kind (index into ``KINDS``), begin and end (code points within the row) of all findings.

    Findings don't overlap: a mail address wins over a number, a number over an address, an address
    over a name. They are sorted by row and position. With ``common`` names are found by shape and
    context too.
    """
    tape, low, at = transduce(cps, off)
    taken: list[tuple[int, int, int]] = []
    plain = (_mails(low, at.get("mail", [])), _phones(low), _ids(low, tape.text, at.get("id", [])), _addresses(low, tape.text, at))
    detectors = [[(a, b) for a, b in found if b > a] for found in plain]
    names = [(a, b) for a, b in _names_in(low, tape.text, at, common or frozenset()) if low[a:b] not in PUBLIC]
    if common is not None:
        names += _shaped_names(low, tape.text, common, at.get("cue", []) + at.get("small", []), [x for found in detectors for x in found])
    for kind, spans in enumerate([*detectors, names]):
        taken += [(a, kind, b) for a, b in spans]
    # better kinds first; of one kind the longer span
    taken.sort(key=lambda x: (_PRIORITY[x[1]], x[0], -x[2]))
    kept: list[tuple[int, int, int]] = []
    if taken:
        starts: list[int] = []
        ends: list[int] = []
        for a, kind, b in taken:
            i = bisect.bisect_right(starts, a)
            if (i and ends[i - 1] > a) or (i < len(starts) and starts[i] < b):
                continue
            starts.insert(i, a)
            ends.insert(i, b)
            kept.append((a, kind, b))
    kept.sort()
    a = np.array([k[0] for k in kept], np.int64)
    b = np.array([k[2] for k in kept], np.int64)
    kind = np.array([k[1] for k in kept], np.int64)
    if not kept:
        return a, kind, a, a
    begin, end = tape.begin[a], tape.end[b - 1]
    row = np.searchsorted(off, begin, "right") - 1
    return row, kind, begin - off[row], end - off[row]


_PRIORITY = {0: 0, 2: 1, 1: 2, 3: 3, 4: 4}

PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}


def common_words(vocabulary: bytes) -> frozenset:
    """Words that a rank file of a public byte-level vocabulary holds in small letters, as whole words."""
    out = set()
    for line in vocabulary.splitlines():
        token = base64.b64decode(line.split()[0]) if line else b""
        if token[:1] == b" " and len(token) > 2:
            word = token[1:].decode("utf-8", "replace")
            if word.isalpha() and word.islower():
                out.add(word)
    return frozenset(out)


def scan(texts: pa.Array, common: frozenset | None = None):
    """Findings of an Arrow string array; nulls have none."""
    return find(*to_code_points(texts), common)


def mask(texts: pa.Array, common: frozenset | None = None) -> tuple[pa.Array, np.ndarray]:
    """The texts with typed placeholders, and the number of findings per row."""
    row, kind, begin, end = scan(texts, common)
    out = texts.to_pylist()
    for r, k, a, b in zip(row[::-1].tolist(), kind[::-1].tolist(), begin[::-1].tolist(), end[::-1].tolist()):
        t = out[r]
        out[r] = t[:a] + PLACEHOLDER[KINDS[k]] + t[b:]
    return pa.array(out, pa.string()), np.bincount(row, minlength=len(out)) if len(row) else np.zeros(len(out), np.int64)
