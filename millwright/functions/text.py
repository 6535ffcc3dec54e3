"""Clean-up of free text as one chain of built-in string expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.naming import let

# What is written on work orders, and what is meant by it. Keys are patterns between word boundaries.
CORRECTIONS = {
    "preasure": "pressure",
    "wotking": "working",
    "2-WAY": "two-way",
    "2WAY": "two-way",
    "2-way": "two-way",
    "2way": "two-way",
    "2 way": "two-way",
    "2 WAY": "two-way",
    "a/c": "air conditioner",
    "a/f": "after cooler",
    "als": "ALS",
    "anti cav": "anti-cavitation",
    "anti-cav": "anti-cavitation",
    "assy": "assembly",
    "auto retard": "auto-retarder",
    "bcs": "BCS",
    "boken": "broken",
    "brke": "brake",
    "brohen": "broken",
    "broked": "broken",
    "c/body": "car body",
    "c/o": "change out",
    "cab": "cabin",
    "cav": "cavitation",
    "cha": "change",
    "chan": "change",
    "chng": "change",
    "cons": "conditioners",
    "contam": "contamination",
    "cyl": "cylinder",
    "cylnder": "cylinder",
    "dcv": "DCV",
    "g . e . t": "GET",
    "g.e.t": "GET",
    "G.E.T": "GET",
    "glr": "GLR",
    "h.p": "high pressure",
    "handpump": "hand pump",
    "hydrolics": "hydraulics",
    "hid": "HID",
    "lhbank": "left hand bank",
    "mech": "mechanical",
    "meteal": "metal",
    "mp": "MP",
    "mstr": "master",
    "o/h": "overhaul",
    "o/stroke": "overstroke",
    "overtemp": "over temperature",
    "ovhl": "overhaul",
    "prssr": "pressure",
    "repl": "replace",
    "rev control": "reverse control",
    "rollar": "roller",
    "rx": "receiving",
    "releif": "relief",
    "schrod": "shroud",
    "schroud": "shroud",
    "senor": "sensor",
    "sht": "shut",
    "shut off": "shut-off",
    "sps": "SPS",
    "stc": "STC",
    "t/stat": "thermostat",
    "temp": "temperature",
    "temps": "temperatures",
    "trvl": "travel",
    "tx": "transmission",
    "u/s": "unserviceable",
    "up/both": "up / both",
    "vhf": "VHF",
    "was n't": "wasn't",
    "wasn t": "wasn't",
    "wind shroud": "wing shroud",
    "cct": "CCT",
    "O&K RH 170": "<id>",
    "O&K": "",
    "L.H.S": "left hand side",
    "l.h.s": "left hand side",
    "ove": "over",
    "intermitently": "intermittently",
    "blwn": "blown",
    "xover": "cross-over",
    "wireing": "wiring",
    "waterpump": "water pump",
    "cambuss": "cambus",
    "windscreane": "windscreen",
    "wieght": "weight",
}

#: Besides letters, digits and spaces, what is kept.
PRESERVED = ",&.#@/-[]()"

#: What a key must not touch: letters and digits of any script, here without and with those that ASCII lacks. Spelt out, since what a word boundary means differs between versions of Java.
LEFT, RIGHT = r"(?<![a-zA-Z0-9_])(?<![\p{L}\p{N}&&[^\x00-\x7F]])", r"(?![a-zA-Z0-9_]|[\p{L}\p{N}])"
#: Keys that one pattern looks for before they are tried one by one.
TOGETHER = 8


def ordered(corrections: dict[str, str]) -> list[tuple[str, str]]:
    """Longest keys first; equally long ones in their given order."""
    return sorted(corrections.items(), key=lambda kv: -len(kv[0]))


def correct(c: Column, corrections: dict[str, str] = CORRECTIONS) -> Column:
    """Replaces each key, in turn, by its spaced value. Keys are tried only in texts that hold one of their group, which changes nothing:
    where no key of a group matches, its replacements leave the text as it is."""
    pairs = ordered(corrections)

    def step(group: list[tuple[str, str]]) -> Callable[[Column], Column]:
        def replaced(x: Column) -> Column:
            y = x
            for wrong, right in group:
                y = F.regexp_replace(y, LEFT + wrong + RIGHT, f" {right} ")
            return F.when(x.rlike(f"{LEFT}(?:{'|'.join(wrong for wrong, _ in group)}){RIGHT}"), y).otherwise(x)

        return replaced

    for k in range(0, len(pairs), TOGETHER):
        c = let(c, step(pairs[k : k + TOGETHER]))
    return c


def strip_codes(c: Column, codes: list[str]) -> Column:
    """Site codes, in any case, become a space."""
    return F.regexp_replace(c, r"(?i)\b(" + "|".join(map(re.escape, codes)) + r")\b", " ") if codes else c


def preserve(c: Column) -> Column:
    """All but letters, digits, spaces and PRESERVED becomes a space."""
    return F.regexp_replace(c, r"[^a-zA-Z0-9 ,&.#@/\-\[\]()]", " ")


def single_marks(c: Column) -> Column:
    """Runs of one preserved mark become one."""
    return F.regexp_replace(c, r"([,&.#@/\-\[\]()])\1+", "$1")


def drop_mixed_tokens(c: Column) -> Column:
    """Tokens of letters and digits become a space."""
    return F.regexp_replace(c, r"\b(?=\w*[a-zA-Z])(?=\w*\d)\w+\b", " ")


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"\b\d+\b", " <num> ")


def spell_marks(c: Column) -> Column:
    """Commas and parentheses get spaces, periods become spaces, brackets parentheses, and signs words."""
    for old, new in ((",", " , "), (".", " "), ("[", "("), ("]", ")"), ("{", "("), ("}", ")"), ("(", " ( "), (")", " ) "), ("&", " and "), ("#", " number "), ("@", " at ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean(c: Column, codes: list[str] | None = None, parity: bool = False) -> Column:
    """The whole chain. ``parity``: an empty result becomes ``nan``, as after a round trip through CSV."""
    c = strip_codes(c, codes or [])
    c = F.replace(c, F.lit("'"), F.lit(""))
    c = single_marks(preserve(c))
    c = mask_numbers(drop_mixed_tokens(correct(c)))
    c = squeeze(correct(F.lower(spell_marks(c))))
    return F.when(c == "", "nan").otherwise(c) if parity else c


def clean_numeric(c: Column) -> Column:
    """Digits and periods of a string as a number; no digits: 0; the sign is lost; null stays null."""
    kept = F.regexp_replace(c, r"[^0-9.]", "")
    return F.when(kept == "", F.lit(0.0)).otherwise(kept.cast("double"))


#: Directives of strftime and Java's letters for them.
DIRECTIVES = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss"}


def java_format(strftime: str) -> str:
    for a, b in DIRECTIVES.items():
        strftime = strftime.replace(a, b)
    return strftime


def word_count(c: Column) -> Column:
    """Words between white space; none in an empty string."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
