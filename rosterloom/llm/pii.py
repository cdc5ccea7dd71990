"""Personal data replaced by surrogates of the same kind.

Entities are e-mail addresses, telephone numbers, IPv4 addresses, payment card
and social security numbers, bank account numbers, secrets, and names after a
form of address, with their mentions without one in the same text.  A surrogate
depends on a key and on the entity's normal form alone, so one entity has one
surrogate wherever it stands, in any spelling:

* digits go through a keyed Feistel permutation of all strings of their length
  (format-preserving encryption), so distinct numbers stay distinct; country
  codes, private address ranges, separators and valid check digits are kept;
* telephone numbers have their country's code in the normal form, whether written
  or, for ten digits in the North American form, not;
* secrets keep their length and the kind of each character;
* addresses become ``<hash>@<hash>.example.<end>``;
* names are drawn by gender and script, given and family names apart, so that
  "Mr. John Smith" and "Mr. Smith" stay one person.  The gender of a given name
  is that of its titles in the whole corpus, and neutral where these differ, so
  that "Dr. John Smith" is the same person, too.

The key comes from the caller, or from the session's ``KEY_SETTING``; where
neither is given, one is drawn at random for the application.

Surrogates are then tested over the whole corpus: of several entities with one
surrogate, and of those whose surrogate is another entity's own form, all but
one draw again.  Entities travel in normal form with a digest of their text;
only texts that may hold an entity are joined, all others pass through.

Defined results: a null text stays null and an empty one empty; equal texts
get equal results, and repeated rows each get theirs, also with a null doc_id; a
text of any length is searched whole; an empty table gives no rows; all columns
of the input are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, give_back

#: Where a session keeps the key, if the caller gives none.
KEY_SETTING = "spark.rosterloom.surrogates.key"
ENTITY_SCHEMA = "digest string, kind string, form string"
SURROGATE_SCHEMA = "kind string, form string, attempt int, surrogate string"
FEISTEL_ROUNDS = 8

# ------------------------------------------------------------------ detection

_TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sir": "m", "господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Señorita": "f", "Lady": "f", "госпожа": "f",
    "Dr": "n", "Prof": "n",
}
_TITLE_KINDS = {title.lower(): gender for title, gender in _TITLES.items()}
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*\w"

_ENTITY = re.compile(
    rf"""
    (?P<email>(?<![\w.+%-])[\w.+%-]*\w@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}(?![\w-]))
  | (?P<secret>(?i:\b(?:access[_-]?key|api[_-]?key|client[_-]?secret|auth[_-]?token|token|secret|password|passwd|pwd)\b["']?\s*[:=]\s*["']?)(?P<value>[^\s"'<>,;]{{8,}}))
  | (?P<key>(?<!\w)(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_\w{{30,}}|sk-[\w-]{{20,}}|xox[abp]-[\w-]{{10,}}|[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}})(?!\w))
  | (?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))
  | (?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
  | (?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
  | (?P<card>(?<![\w+.-])\d(?:[ -]?\d){{12,18}}(?![\w-]|\.\d))
  | (?P<phone>(?<![\w.])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,12}}(?:[ .-]\d{{2,8}}){{0,4}}|(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{2,4}}(?:[ .-]\d{{2,4}}){{1,3}})(?!\w|[.-]\d))
  | (?P<name>(?<!\w)(?P<title>(?i:{"|".join(_TITLES)}))(?:\.?(?:[^\S\r\n]+(?:\r?\n[^\S\r\n]*)?|\r?\n[^\S\r\n]*))(?P<words>{_CAPITAL}(?:[ ]{_CAPITAL}){{0,2}}))
    """,
    re.VERBOSE,
)

#: What a text must hold for any of the above to match; tested in the JVM.
_HINTS = ("sk-", "xox", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "AKIA")
_TITLE_HINT = rf"(?iu)(?<![\p{{L}}0-9_])(?:{'|'.join(_TITLES)})\.?[\s\x1c-\x1f\x85\p{{Z}}]"
_WORD_HINTS = "(?i)key|token|secret|passw|pwd"


def may_hold_entities(text: Column) -> Column:
    """A cheap test that is true for every text with an entity, and seldom for others."""
    # digits of any script, and what this JVM may not know yet
    hint = text.rlike(r"[\p{Nd}\p{Cn}@]|[a-f]{32}|[A-F]{32}")
    for word in _HINTS:
        hint = hint | text.contains(word)
    return F.coalesce(hint | text.rlike(_WORD_HINTS) | text.rlike(_TITLE_HINT), F.lit(False))


def _digits(text: str) -> str:
    """The digits of any script, as ASCII."""
    return "".join(str(int(c)) for c in text if c.isdecimal())


def _luhn_sum(digits: str) -> int:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))


def _iban_valid(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _script(text: str) -> str:
    return "cyrillic" if "Ѐ" <= text[0] <= "ӿ" else "latin"


#: Characters of a bank account number by country.
_IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
_NATIONAL = re.compile(r"(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[.-]\d{4}(?= |$)")


#: Calling codes of one and two digits; all others have three.
_ONE_DIGIT = frozenset("17")
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _country_digits(digits: str) -> int:
    return 1 if digits[0] in _ONE_DIGIT else 2 if digits[:2] in _TWO_DIGITS else 3


def canonical(kind: str, form: str) -> tuple[str, str]:
    """Kind and normal form that all spellings of an entity share.

    A telephone number is "<country>/<national>", with no country where none is
    known.  A given name keeps its gender in its kind; ``genderless`` drops it.
    """
    if not kind.startswith("phone") or kind == "phone":
        return kind, form
    country = int(kind[5:])
    if not country and (len(form) == 10 and form[0] > "1"):
        return "phone", f"1/{form}"
    if not country and len(form) == 11 and form[0] == "1" and form[1] > "1":
        country = 1
    return "phone", f"{form[:country]}/{form[country:]}"


def genderless(kind: str) -> str:
    return re.sub("^given-[mfn]-", "given-", kind)


def _prefixes(text: str) -> Iterator[str]:
    """The text, and what ends before each of its blanks, longest first."""
    while text:
        yield text
        text = text.rpartition(" ")[0]


def _iban(text: str) -> str | None:
    """The longest beginning that is a valid account number, of its country's length where that is known."""
    for some in _prefixes(text):
        code = some.replace(" ", "")
        if 15 <= len(code) <= 34 and len(code) == _IBAN_LENGTHS.get(code[:2], len(code)) and _iban_valid(code):
            return some
    return None


def _phone(text: str) -> str | None:
    """The beginning that is a telephone number; neighbours after a national number are not part of it."""
    if m := _NATIONAL.match(text):
        return m[0]
    return next((some for some in _prefixes(text) if 9 <= len(_digits(some)) <= 15), None)


def _card(text: str) -> str:
    """The longest beginning with a valid check digit, else the whole."""
    return next((some for some in _prefixes(text) if len(d := _digits(some)) >= 13 and _luhn_sum(d) % 10 == 0), text)


_POSSESSIVE = re.compile(r"\w\w['’][sS]$")

#: (start, end, kind, normal form, written form) of an entity in a text.
Found = tuple[int, int, str, str, str]


def _name_words(at: int, name: str, gender: str) -> Iterator[Found]:
    words = list(re.finditer(r"\S+", name))
    for word in words:
        part = "family" if word is words[-1] else f"given-{gender}"
        yield at + word.start(), at + word.end(), f"{part}-{_script(word[0])}", word[0].lower(), word[0]


def _with_names(text: str, others: list[Found], names: list[tuple[int, str, str]]) -> list[Found]:
    """Adds the words of titled names (start, words, gender), and their mentions without a title.

    A name after a title without gender takes the one that it has after another title of the text.
    """
    genders: dict[str, str] = {}
    for _, name, gender in names:
        if gender != "n" and genders.setdefault(name.lower(), gender) != gender:
            genders[name.lower()] = "n"
    titled = [found for at, name, gender in names for found in _name_words(at, name, genders.get(name.lower(), "n") if gender == "n" else gender)]
    full = {name.lower(): genders.get(name.lower(), gender) for _, name, gender in names}
    words: dict[str, str] = {}
    for _, _, kind, form, _ in titled:
        words.setdefault(form, kind)
    taken = sorted([*others, *titled])
    spelled = sorted({*full, *words}, key=lambda x: (-len(x), x))
    mention = re.compile(rf"(?<!\w)(?:{'|'.join(r'\s+'.join(map(re.escape, x.split())) for x in spelled)})(?!\w)", re.IGNORECASE)
    out, at, k = [], 0, 0
    while m := mention.search(text, at):
        start, end = m.span()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        capital = all(word[0].isupper() for word in m[0].split())
        if not capital or (k < len(taken) and taken[k][0] < end):
            at = start + 1
            continue
        form = " ".join(m[0].lower().split())
        out += _name_words(start, m[0], full[form]) if form in full and " " in form else [(start, end, words[form], form, m[0])] if form in words else []
        at = end
    return sorted([*taken, *out])


def find_entities(text: str) -> list[Found]:
    """Entities from left to right, without overlap."""
    out: list[Found] = []
    names: list[tuple[int, str, str]] = []
    at, barred = 0, 0
    while m := _ENTITY.search(text, at):
        start, end = m.span()
        if m["email"]:
            kind, form = "email", m[0].lower()
        elif m["secret"]:
            kind, (start, end), form = "secret", m.span("value"), m["value"]
        elif m["key"]:
            kind, form = "secret", m[0]
        elif m["ip"]:
            kind, form = "ip", ".".join(str(int(x)) for x in m[0].split("."))
        elif m["iban"]:
            some = _iban(m[0])
            if some is None:
                # what looks like an account number holds no telephone number, but another account number or a card
                at, barred = start + 1, max(barred, end)
                continue
            kind, form, end = "iban", some.replace(" ", ""), start + len(some)
        elif m["ssn"]:
            kind, form = "ssn", _digits(m[0])
        elif m["card"] and not _NATIONAL.match(m[0]):
            some = _card(m[0])
            kind, form, end = "card", _digits(some), start + len(some)
            if start < barred and _luhn_sum(form) % 10:
                at = end
                continue
        elif m["card"] or m["phone"]:
            some = _phone(m[0])
            if some is None or start < barred:
                at = start + 1
                continue
            form, end = _digits(some), start + len(some)
            kind = f"phone{_country_digits(form) if some.startswith('+') else 0}"
        else:
            words = m["words"]
            words = words[:-2] if _POSSESSIVE.search(words) else words
            names.append((m.start("words"), words, _TITLE_KINDS.get(m["title"].lower(), "n")))
            at = end
            continue
        out.append((start, end, kind, form, text[start:end]))
        at = end
    return _with_names(text, out, names) if names else out


# ------------------------------------------------------------------ surrogates


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permute(key: bytes, tweak: str, value: int, left: int, right: int) -> int:
    """A keyed permutation of the integers below ``left * right`` (an unbalanced Feistel network)."""
    a, b = divmod(value, right)
    for k in range(0, FEISTEL_ROUNDS, 2):
        a = (a + _number(key, tweak, k, b)) % left
        b = (b + _number(key, tweak, k + 1, a)) % right
    return a * right + b


def permute_digits(key: bytes, tweak: str, digits: str) -> str:
    """Another string of as many digits; distinct for distinct ones."""
    n = len(digits)
    if not n:
        return ""
    left = 10 ** (n // 2)
    return str(permute(key, f"{tweak}/{n}", int(digits), left, 10**n // left)).zfill(n)


def _private(ip: int) -> tuple[int, int] | None:
    """First address and size of the reserved range of an address, if it is in one."""
    for first, bits in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24), (0xA9FE0000, 16)):
        if first <= ip < first + (1 << bits):
            return first, bits
    return None


_LATIN_SYLLABLES = ("bar", "ben", "cor", "dal", "den", "fal", "gar", "hal", "kel", "lan", "len", "mar", "mor", "nel", "par", "ral", "ren", "sal", "tor", "vel", "wal", "win", "yar", "zel")
_CYRILLIC_SYLLABLES = ("бар", "бел", "вол", "гор", "дан", "зор", "кар", "лан", "мар", "нел", "пал", "рад", "сол", "тар", "фел", "яр")
_ENDINGS = {
    ("family", "latin"): ("son", "ford", "ley", "man"), ("given-m", "latin"): ("us", "ard", "o", "in"), ("given-f", "latin"): ("a", "ine", "elle", "ia"), ("given-n", "latin"): ("y", "is", "en", "ey"),
    ("family", "cyrillic"): ("ко", "юк", "их", "енко"), ("given-m", "cyrillic"): ("ан", "ей", "ил", "ов"), ("given-f", "cyrillic"): ("а", "ия", "ина", "ея"), ("given-n", "cyrillic"): ("и", "ень", "ель", "ай"),
}


def _drawn_name(key: bytes, kind: str, form: str, attempt: int) -> str:
    part, _, script = kind.rpartition("-")
    syllables = _LATIN_SYLLABLES if script == "latin" else _CYRILLIC_SYLLABLES
    n, out = _number(key, kind, form, attempt), ""
    for _ in range(2 + attempt // 4):
        n, k = divmod(n, len(syllables))
        out += syllables[k]
    endings = _ENDINGS[part, script]
    return out + endings[n % len(endings)]


def _same_class(key: bytes, kind: str, form: str, attempt: int) -> str:
    """Random characters, each of the class of the one in its place."""
    hexadecimal = re.fullmatch("[0-9a-f]+|[0-9A-F]+", form) is not None
    out = []
    for k, c in enumerate(form):
        if k % 16 == 0:
            n = _number(key, kind, form, attempt, k)
        if hexadecimal:
            classes = "0123456789abcdef" if form == form.lower() else "0123456789ABCDEF"
        else:
            classes = "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else c
        n, i = divmod(n, len(classes))
        out.append(classes[i])
    return "".join(out)


def make_surrogate(key: bytes, kind: str, form: str, attempt: int = 0) -> str:
    """The surrogate's normal form."""
    kind, form = canonical(kind, form)
    tweak = f"{kind}/{attempt}"
    if kind == "email":
        local, _, domain = form.rpartition("@")
        n = _number(key, "local", local, domain, attempt)
        name = "".join("abcdefghijklmnopqrstuvwxyz234567"[(n >> 5 * k) & 31] for k in range(12))
        return f"{name}@d{_number(key, 'domain', domain) % 10**8:08d}.example.{domain.rpartition('.')[2]}"
    if kind == "secret":
        return _same_class(key, kind, form, attempt)
    if kind == "ip":
        value = int.from_bytes(bytes(map(int, form.split("."))), "big")
        if reserved := _private(value):
            first, bits = reserved
            value = first + permute(key, f"{tweak}/{first}", value - first, 1 << bits // 2, 1 << bits - bits // 2)
        else:
            value = permute(key, tweak, value, 1 << 16, 1 << 16)
            while _private(value):  # walks the cycle on, so that distinct addresses stay distinct
                value = permute(key, tweak, value, 1 << 16, 1 << 16)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "iban":
        filled, digits = "", iter(permute_digits(key, f"{tweak}/{form[:2]}", _digits(form[4:])))
        for k, c in enumerate(form[4:]):
            filled += next(digits) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[(ord(c) - 65 + _number(key, tweak, k)) % 26]
        rest = int("".join(str(int(c, 36)) for c in filled + form[:2] + "00")) % 97
        return f"{form[:2]}{98 - rest:02d}{filled}"
    if kind == "card":
        if _luhn_sum(form) % 10 == 0:
            body = form[0] + permute_digits(key, f"{tweak}/valid/{form[0]}", form[1:-1])
            return body + str(-_luhn_sum(body + "0") % 10)
        value = form
        while True:  # numbers without a valid check digit stay so
            value = form[0] + permute_digits(key, f"{tweak}/{form[0]}", value[1:])
            if _luhn_sum(value) % 10:
                return value
    if kind == "phone":
        country, _, national = form.partition("/")
        return f"{country}/{permute_digits(key, f'{tweak}/{country}', national)}"
    if kind == "ssn":
        return permute_digits(key, tweak, form)
    return _drawn_name(key, kind, form, attempt)


def written(kind: str, surrogate: str, original: str) -> str:
    """The surrogate in the format of the original's spelling."""
    if kind in ("email", "ip", "secret"):
        return surrogate
    if kind.startswith(("family", "given")):
        return surrogate.upper() if original.isupper() and len(original) > 1 else surrogate[:1].upper() + surrogate[1:]
    own = [c for c in surrogate if c.isalnum()]
    rest = iter(own[max(0, len(own) - sum(map(str.isalnum, original))) :])  # a number written without its country's code has just the end
    return "".join(next(rest) if c.isalnum() else c for c in original)


def replace_found(text: str, surrogate) -> tuple[str, int]:
    """The text with each entity replaced by ``surrogate(kind, form)``, and their number."""
    out, at, found = [], 0, find_entities(text)
    for start, end, kind, form, original in found:
        out += [text[at:start], written(kind, surrogate(kind, form), original)]
        at = end
    return "".join([*out, text[at:]]), len(found)


# ------------------------------------------------------------------ Spark


def _detect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(digest, kind, form) for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True) for kind, form in dict.fromkeys(canonical(f[2], f[3]) for f in find_entities(text or ""))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["digest", "kind", "form"])
    give_back()


def _draw(batches: Iterable[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "form", "attempt")), strict=True))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("kind", "form", "attempt")), pa.array([make_surrogate(key, *r) for r in rows], pa.string())], names=["kind", "form", "attempt", "surrogate"]
        )


def surrogate_table(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """kind, form, attempt and surrogate of each distinct entity, without collisions.

    An entity draws again while its surrogate is some entity's own form, or while
    an entity of the same kind with a smaller form has the same surrogate.
    """
    known = scratch.save(entities.select("kind", "form").distinct(), "entities")
    table = scratch.save(known.withColumn("attempt", F.lit(0)).mapInArrow(lambda it: _draw(it, key), SURROGATE_SCHEMA), "surrogates")
    while True:
        holders = table.groupBy("kind", "surrogate").agg(F.min("form").alias("holder"))
        own = known.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("own"))
        tested = table.join(holders, ["kind", "surrogate"]).join(own, ["kind", "surrogate"], "left")
        again = scratch.save(tested.filter((F.col("form") != F.col("holder")) | F.col("own")).select("kind", "form", (F.col("attempt") + 1).alias("attempt")), "again")
        if not again.limit(1).count():
            return table
        kept = table.join(again.select("kind", "form"), ["kind", "form"], "left_anti")
        drawn = again.mapInArrow(lambda it: _draw(it, key), SURROGATE_SCHEMA)
        new = scratch.save(kept.unionByName(drawn), "surrogates")
        scratch.drop(table, again)
        table = new


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist(), strict=True):
            table = {(genderless(x["kind"]), x["form"]): x["surrogate"] for x in known or ()}

            def drawn(kind: str, form: str, table: dict = table) -> str:
                kind, form = canonical(kind, form)
                return table[genderless(kind), form]

            new, n = replace_found(text, drawn) if text else (text, 0)
            texts.append(new)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["kept", "text", "n_entities"])
    give_back()


_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's settings, else one drawn for the application."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def with_genders(entities: DataFrame) -> DataFrame:
    """digest, kind and form with one gender of each given name: that of its titles in all texts, if they agree."""
    parts = F.split("kind", "-")
    given = F.col("kind").startswith("given-")
    named = entities.filter(given).select("form", parts[2].alias("script"), F.when(parts[1] != "n", parts[1]).alias("gender"))
    lo, hi = F.min("gender"), F.max("gender")
    genders = named.groupBy("form", "script").agg(F.when(lo == hi, lo).otherwise("n").alias("gender"))
    joined = entities.withColumn("script", F.when(given, parts[2])).join(genders, ["form", "script"], "left")
    return joined.select("digest", F.when(given, F.concat_ws("-", F.lit("given"), "gender", "script")).otherwise(F.col("kind")).alias("kind"), "form").distinct()


def replace_entities(docs: DataFrame, key: bytes | None = None, scratch: Scratch | None = None) -> DataFrame:
    """kept (a struct of all other columns), text with surrogates, and n_entities, of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "surrogates")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("kept"), "text")
    # written, so that its many tests of each text run once for detection and replacement
    likely = scratch.save(rows.filter(may_hold_entities(F.col("text"))).withColumn("digest", F.sha2("text", 256)), "likely")
    found = scratch.save(likely.select("digest", "text").mapInArrow(_detect, ENTITY_SCHEMA).distinct(), "found")
    entities = scratch.save(with_genders(found), "entities")
    table = surrogate_table(entities, key or session_key(spark), scratch)
    known = entities.join(table, ["kind", "form"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "form", "surrogate")).alias("known"))
    joined = likely.join(known, "digest", "left").select("kept", "text", "known")
    schema = T.StructType([joined.schema["kept"], T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType())])
    changed = joined.mapInArrow(_apply, schema)
    untouched = rows.filter(~may_hold_entities(F.col("text"))).select("kept", "text", F.lit(0).cast("long").alias("n_entities"))
    return untouched.unionByName(changed)
