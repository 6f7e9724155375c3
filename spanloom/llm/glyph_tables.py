"""Lookup tables of visually identical characters, derived from Unicode's own data where a rule exists."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Letters of other scripts that look like a Latin letter, as pairs.
CYRILLIC = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ЅS ІI ЈJ ԚQ ԜW ҮY ӏl"
GREEK = "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϳj ϹC"
OTHER = "ɡg ɑa ıi ⅼl ⅰi ⅴv ⅹx ⅽc ⅾd ⅿm օo սu հh"
# Hyphens that look like the ordinary one.
HYPHENS = (0x2010, 0x2011, 0xFE63)

#: Code points from here on (private planes, tags) are kept as they are, except tag characters.
LIMIT = 0x30000
SIZE = 0x110000


class Tables(NamedTuple):
    one: np.ndarray  # replacement by one code point
    length: np.ndarray  # number of code points that replace one: 0 deletes it
    solid: np.ndarray  # the composed letter, where a replacement makes one; else 0
    start: np.ndarray  # where longer replacements begin in ``flat``
    flat: np.ndarray
    rank: np.ndarray  # canonical combining class
    pair_key: np.ndarray  # sorted (base << 21 | mark)
    pair_to: np.ndarray


def _invisible(cp: int) -> bool:
    return unicodedata.category(chr(cp)) == "Cf" and not 0x600 <= cp <= 0x6DD and cp not in (0x70F, 0x8E2) or cp == 0x34F or 0xFE00 <= cp <= 0xFE0F


def _compatible(ch: str) -> str | None:
    """What a full-width, half-width or ligature character stands for; None for all others."""
    d = unicodedata.decomposition(ch)
    if not d.startswith("<"):
        return None
    kind, *cps = d.split()
    text = "".join(chr(int(x, 16)) for x in cps)
    if kind in ("<wide>", "<narrow>"):
        return text
    if kind == "<compat>" and len(text) > 1 and text.isalpha() and ("LIGATURE" in unicodedata.name(ch, "") or 0x132 <= ord(ch) <= 0x1F3):
        return text
    return None


@lru_cache(maxsize=1)
def tables() -> Tables:
    alike = {}
    for pair in f"{CYRILLIC} {GREEK} {OTHER}".split():
        alike[pair[0]] = pair[1]

    def full(ch: str, depth: int = 0) -> str:
        """The complete replacement: canonical and compatible parts taken apart, each part folded."""
        if depth < 8:
            if (c := _compatible(ch)) is not None:
                return "".join(full(x, depth + 1) for x in c)
            d = unicodedata.decomposition(ch)
            if d and not d.startswith("<"):
                return "".join(full(chr(int(x, 16)), depth + 1) for x in d.split())
        return alike.get(ch, ch)

    one = np.arange(SIZE, dtype=np.uint32)
    length = np.ones(SIZE, np.uint8)
    solid = np.zeros(SIZE, np.uint32)
    start = np.zeros(SIZE, np.int32)
    rank = np.zeros(SIZE, np.uint8)
    flat: list[int] = []
    pairs: dict[int, int] = {}
    for cp in range(0x80, LIMIT):
        if 0xAC00 <= cp <= 0xD7FF or 0xD800 <= cp <= 0xF8FF or 0x3400 <= cp <= 0x9FFF:
            continue
        ch = chr(cp)
        rank[cp] = unicodedata.combining(ch)
        if _invisible(cp):
            length[cp] = 0
            continue
        if unicodedata.category(ch) == "Zs":
            one[cp] = 0x20
            continue
        if cp in HYPHENS:
            one[cp] = 0x2D
            continue
        to = full(ch)
        if to == ch:
            continue
        if len(to) == 1:
            one[cp] = ord(to)
        else:
            length[cp], start[cp] = len(to), len(flat)
            flat.extend(map(ord, to))
            whole = unicodedata.normalize("NFC", to)
            if len(whole) == 1:
                solid[cp] = ord(whole)
        d = unicodedata.decomposition(ch).split()
        if len(d) == 2 and not d[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            base, mark = (full(chr(int(x, 16))) for x in d)
            if len(mark) == 1 and unicodedata.combining(mark):
                # the base as it stands after folding and composing what it is itself made of
                whole = unicodedata.normalize("NFC", base)
                if len(whole) == 1:
                    key = ord(whole) << 21 | ord(mark)
                    pairs[key] = min(cp, pairs.get(key, cp))
    for cp in range(0xE0000, 0xE01F0):
        length[cp] = 0
    keys = np.array(sorted(pairs), np.uint64)
    to = np.array([pairs[int(k)] for k in keys], np.uint32)
    return Tables(one, length, solid, start, np.array(flat, np.uint32), rank, keys, to)
