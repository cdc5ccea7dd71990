"""Text expressions for Spark columns, and the same rules for Python values.

The Python forms serve the grouped state machines, so that a rule has one pattern
whichever side runs it.
"""

import json
import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

# ------------------------------------------------------------------ Python values


@cache
def rx(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(P.END, r"\Z"), re.ASCII)


def squash(text: str | None) -> str:
    """White space runs as one space each, none at the ends."""
    return re.sub(f"{P.S}+", " ", text or "").strip(" ")


def first(pattern: str, text: str | None) -> str | None:
    m = rx(pattern).search(text or "")
    return m[0] if m else None


def strip_accents(text: str) -> str:
    """Compatibility decomposition without combining marks (U+0300 to U+036F)."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F)


def identity(text: str | None) -> str:
    """Lower-case ASCII words of a text, for comparison."""
    plain = strip_accents(text or "")
    return re.sub("[^a-z0-9]+", " ", plain.lower().replace("&", " and ")).strip()


def address_identity(text: str | None) -> str:
    return reduce(lambda out, pair: re.sub(rf"\b(?:{pair[0]})\b", pair[1], out), P.ADDRESS_WORDS, identity(text))


def trimmed(text: str | None) -> str:
    return re.sub(rf"^{P.S}+|{P.S}+\Z", "", text or "")


def is_meaningful(text: str | None) -> bool:
    text = trimmed(text)
    return bool(text) and rx(P.PLACEHOLDER).search(text) is None


# ------------------------------------------------------------------ Spark columns


def squash_col(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{P.S}+", " "))


def trim_col(c: Column) -> Column:
    # white space is a class of many parts; most texts have none at their ends
    return F.when(c.rlike(r"^[^!-~]|[^!-~]\z"), F.regexp_replace(c, rf"^{P.S}+|{P.S}+\z", "")).otherwise(c)


def find(c: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.regexp_substr(c, F.lit(pattern))


def group(c: Column, pattern: str, k: int = 1) -> Column:
    """A group of the first match, or null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def replace_first(c: Column, pattern: str, by: str) -> Column:
    """Only the first match replaced; groups inside ``pattern`` must not capture."""
    flags, body = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
    return F.regexp_replace(c, rf"{flags}^(.*?)(?:{body})", f"$1{by}")


#: A placeholder or nothing, between white space; most values end at their first character, as no placeholder begins with it.
_BLANK = P.PLACEHOLDER.replace("^", f"^(?![a-mo-tv-z0-9]){P.S}*").replace(P.END, f"?{P.S}*{P.END}")


def meaningful(c: Column) -> Column:
    return F.coalesce(~c.rlike(_BLANK), F.lit(False))


@cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """What characters beyond ASCII are in an identity text, from the Unicode tables: those that
    are one ASCII letter, digit or ampersand (followed by those that vanish), what they are, and
    those that are several characters.  All others are blanks there.
    """
    single, gone, several = {}, [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        plain = re.sub("[^a-z0-9&]+", " ", strip_accents(chr(code)).lower())
        if not plain:
            gone.append(chr(code))
        elif len(plain) == 1 and plain != " ":
            single[chr(code)] = plain
        elif plain != " ":
            several[chr(code)] = plain
    return "".join([*single, *gone]), "".join(single.values()), several


def _spans(letters: str, gap: int = 64) -> str:
    """A class of few ranges that holds all the letters; beyond U+2000 those between near ones too."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if spans and code - spans[-1][1] <= (gap if spans[-1][0] > 0x2000 else 1):
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in spans) + "]"


def _without_accents(c: Column) -> Column:
    """The text with ASCII letters for those that decompose into them; only texts beyond ASCII are looked at.

    Characters that become several are rare: texts that may hold one are cut at them.
    """
    letters, plain, several = _plain_letters()
    names, rare = F.from_json(F.lit(json.dumps(several)), "map<string,string>"), _spans("".join(several))
    pieces = F.split(F.regexp_replace(F.translate(c, "\x01", " "), f"({rare})", "\x01$1\x01"), "\x01")
    spelled = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(names, x), x)), "")
    known = F.when(c.rlike(rare), spelled).otherwise(c)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(known, letters, plain))


def identity_col(c: Column, accents: bool = True) -> Column:
    """The column form of ``identity``; null gives an empty text.

    With ``accents`` false, for columns known to be ASCII, nothing is looked up.
    """
    plain = _without_accents(c) if accents else c
    words = F.regexp_replace(F.replace(F.lower(plain), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    return F.coalesce(F.trim(words), F.lit(""))


def abbreviate_col(words: Column) -> Column:
    """Address words of an identity text, abbreviated."""
    short = F.create_map(*(F.lit(x) for names, by in P.ADDRESS_WORDS for name in names.split("|") if name != by for x in (name, by)))
    return F.array_join(F.transform(F.split(words, " "), lambda x: F.coalesce(F.try_element_at(short, x), x)), " ")
