"""Expressions over candidate rows: cleaning, scoring, review, keys and field quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import abbreviate_col, find, group, identity_col, meaningful, replace_first, squash_col, trim_col


def list_kind(c: Column) -> Column:
    """current, former or signed-but-not-open, by the first family of phrases; null without any."""
    text = squash_col(c)
    return (
        F.when(text.rlike(P.BOTH_LISTS), None).when(text.rlike(P.PLANNED_LIST), "signed-but-not-open").when(text.rlike(P.FORMER_LIST), "former").when(text.rlike(P.CURRENT_LIST), "current")
    )


def heading_kind(c: Column) -> Column:
    """The kind of list that a line heads, or null if it is no heading."""
    text = squash_col(c)
    refused = (
        (text == "") | (F.length(text) > 180) | text.rlike("^[a-z]") | text.rlike("^[0-9]+ +[A-Za-z]") | text.rlike(P.DOTTED_RANGE_TAIL)
        | text.rlike(r"(?i)table of contents|item 20 *[-–—:]? *\z")
    )
    core = text
    for prefix in (r"(?i)^(?:EXHIBIT|EX\.) *[A-Z0-9-]+ *[-–—:]? *", r"(?i)^[A-Z] *- *[0-9]+ *[-.)–—:] *", r"(?i)^[A-Z][0-9]? *[-.)–—:] *", rf"(?i)^[A-Z][0-9]? +(?=LIST{P.EDGE})"):
        core = F.regexp_replace(core, prefix, "")
    return F.when(~refused & F.trim(core).rlike(P.LIST_START), list_kind(core))


def kind_status(kind: Column) -> Column:
    return F.when(kind == "current", "Current").when(kind == "former", "Former").otherwise("Planning")


def heading_status(c: Column) -> Column:
    """The status that a line sets, or null if it sets none."""
    text = F.upper(squash_col(c))
    return F.when(text.rlike(P.PLANNED_HEADING), "Planning").when(text.rlike(P.FORMER_HEADING), "Former").when(text.rlike(P.CURRENT_HEADING), "Current")


def footer_label(text: Column) -> Column:
    """The last number of at most four digits in a page's last six lines."""
    lines = F.split(text, r"\r?\n")
    last = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 5, F.lit(1)), 6), " ")
    # from the end: the last run of digits before an edge, of which the last four count
    return group(last, rf"(?s)^.*(?<![0-9])[0-9]*?([0-9]{{1,4}}){P.EDGE}").cast("int")


def brand_value(c: Column) -> Column:
    """A brand as it is stored: known ones in their own spelling, refused words empty."""
    text = F.trim(F.regexp_replace(squash_col(c), r"[.,;:]+\z", ""))
    known = F.lit(None).cast("string")
    for pattern, name in reversed(P.BRANDS):
        known = F.when(text.rlike(pattern), name).otherwise(known)
    return F.when((text == "") | text.rlike(P.INVALID_BRAND), "").otherwise(F.coalesce(known, text))


def brand_from_filename(name: Column) -> Column:
    stem = F.element_at(F.split(F.regexp_replace(name, r"(?i)\.pdf\z", ""), rf"(?:[-_{P.SPACE}]+)20[0-9]{{2}}(?:[-_{P.SPACE}]+|\z)"), 1)
    value = brand_value(F.regexp_replace(stem, "[-_]+", " "))
    return F.when(value == "", "Uploaded FDD").otherwise(value)


def upload_name(name: Column) -> Column:
    """The document name given at upload: the file name up to its year."""
    spaced = F.regexp_replace(name, "[-_]", " ")
    cut = F.trim(F.regexp_replace(F.regexp_replace(spaced, r"(?s)20[0-9]{2}.*\z", ""), r"(?i)\.pdf\z", ""))
    return F.when(cut == "", "Uploaded FDD").otherwise(cut)


def upload_year(name: Column) -> Column:
    return find(name, "20[0-9]{2}").cast("int")


def clean_entity(c: Column) -> Column:
    """An entity without counters, contact details and what follows its legal form; null if nothing is left."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{P.S}*[0-9]+[.)]?{P.S}*", "")
    text = squash_col(replace_first(replace_first(text, P.EMAIL, " "), P.PHONE, " "))
    end = F.regexp_instr(text, F.lit(P.ENTITY_END)) - 1 + F.length(find(text, P.ENTITY_END))
    text = F.when(end > 0, F.trim(F.substring(text, F.lit(1), end))).otherwise(text)
    refused = (text == "") | text.rlike(P.HEADER_OR_NOTE) | (F.length(text) > 160) | text.rlike(P.DOCUMENT_WORDS)
    return F.when(~refused, F.nullif(trim_col(F.regexp_replace(text, r"[|;,]+\z", "")), F.lit("")))


def sanitize(df: DataFrame) -> DataFrame:
    """Candidates with missing phone and email taken from the raw text, and clean entities."""
    raw = F.coalesce("raw_source_text", F.lit(""))
    return df.withColumns({
        "phone": F.coalesce("phone", find(raw, P.PHONE)),
        "email": F.coalesce("email", find(raw, P.EMAIL)),
        "franchisee_entity": clean_entity(F.col("franchisee_entity")),
    })


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def evidence(address="address", city="city", state="state", zip_code="zip", entity="franchisee_entity", phone="phone", email="email", section="source_section", exhibit="source_exhibit") -> dict[str, Column]:
    """What a row discloses, as flags."""
    a, z, s = F.col(address), F.col(zip_code), F.col(state)
    filled = lambda c: _flag(F.col(c) != "")
    return {
        "address": meaningful(a) & _flag(trim_col(a).rlike(rf"^[0-9]+{P.S}+[^{P.SPACE}]+")),
        "geo": meaningful(F.col(city)) & _flag(s.rlike(r"^[A-Z]{2}\z")),
        "zip": _flag(z.rlike(r"^[0-9]{5}(?:-[0-9]{4})?\z")),
        "entity": meaningful(F.col(entity)),
        "contact": filled(phone) | filled(email),
        "citation": filled(section) | filled(exhibit),
    }


def score(flags: dict[str, Column]) -> Column:
    """Confidence from the fields that are there, capped without address or entity."""
    points = {"address": 0.3, "geo": 0.15, "zip": 0.1, "entity": 0.15, "contact": 0.05, "citation": 0.05}
    total = F.lit(0.15)
    for name, value in points.items():
        total = total + F.when(flags[name], F.lit(value)).otherwise(F.lit(0.0))
    total = F.when(flags["address"], total).otherwise(F.least(total, F.lit(0.58)))
    total = F.when(flags["entity"], total).otherwise(F.least(total, F.lit(0.68)))
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), total)), 3)


def issues(flags: dict[str, Column]) -> Column:
    """Notes on what is missing, in fixed order."""
    note = lambda condition, text: F.when(condition, F.lit(text))
    return F.array_compact(
        F.array(
            note(~flags["address"], P.ISSUE_ADDRESS),
            note(~flags["geo"], P.ISSUE_GEO),
            note(~flags["entity"], P.ISSUE_ENTITY),
            note(~flags["zip"] & flags["address"], P.ISSUE_ZIP),
        )
    )


def review(df: DataFrame, ocr: str = "page_ocr", ocr_confidence: str = "page_ocr_confidence") -> DataFrame:
    """Sets confidence, review_status and review_reason of sanitized candidates."""
    flags = evidence()
    base, notes, scanned = score(flags), issues(flags), F.coalesce(F.col(ocr), F.lit(False))
    verified = (F.size(notes) == 0) & ~scanned & (base >= 0.85)
    reason = F.when(F.size(notes) > 0, F.array_join(notes, "; ")).when(verified, P.NOTE_VERIFIED).otherwise(P.NOTE_OCR)
    percent = F.when(F.col(ocr_confidence).isNull(), "unavailable").otherwise(F.concat(F.floor(F.col(ocr_confidence) * 100 + 0.5).cast("string"), F.lit("%")))
    scaled = F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), base * F.coalesce(F.col(ocr_confidence), F.lit(0.5)))), 3)
    return df.withColumns({
        "confidence": F.when(scanned, scaled).otherwise(base),
        "review_status": F.when(verified, "Auto-verified").otherwise("Needs review"),
        "review_reason": F.when(scanned, F.concat(reason, F.lit("; OCR confidence "), percent)).otherwise(reason),
    })


def dedup_key() -> Column:
    """The key of a candidate among those of its document; missing parts are empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    raw = part(F.col("raw_source_text"))
    open_address = part(F.col("address")).rlike("(?i)not disclosed") | (part(F.col("address")) == "")
    return F.concat_ws(
        ":", part(F.col("status")), part(F.lower("address")), part(F.lower("city")), part(F.col("state")), part(F.col("zip")),
        part(F.when(raw.rlike("(?i)Location code:"), group(raw, rf"(?i)Location code:{P.S}*([A-Z]{{2}}[0-9]{{4}})"))),
        F.when(open_address, part(F.lower("franchisee_entity"))).otherwise(F.lit("")),
    )


def identity_keys(accents: bool = True, code="location_code", raw="raw_source_text", address="address", city="city", state="state", entity="franchisee_entity", status="status", zip_code="zip") -> dict[str, Column]:
    """The four identity keys of a location; empty where a part that they need is missing."""
    plain = lambda c: identity_col(F.col(c), accents)
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    own = bare(plain(code))
    street, town, region, name, text = abbreviate_col(plain(address)), plain(city), plain(state), plain(entity), plain(raw)
    placed = meaningful(F.col(city)) & meaningful(F.col(state))
    none = F.lit("")
    return {
        "code": F.when(own != "", own).otherwise(bare(identity_col(group(F.col(raw), P.LOCATION_CODE), accents))),
        "address": F.when(meaningful(F.col(address)) & placed, F.concat_ws("|", street, town, region)).otherwise(none),
        "entity": F.when((F.length(name) >= 5) & placed, F.concat_ws("|", name, town, region)).otherwise(none),
        "exact": F.when((text != "") & (name != ""), F.concat_ws("|", plain(status), name, street, town, region, plain(zip_code), text)).otherwise(none),
    }


def field_quality(field: str, c: Column) -> Column:
    """How well formed a value is: 0 (none) to 4."""
    text = trim_col(c)
    tests = {
        "address": text.rlike(rf"^[0-9]+{P.S}+[^{P.SPACE}]+"),
        "email": text.rlike(rf"^[^{P.SPACE}@]+@[^{P.SPACE}@]+\.[^{P.SPACE}@]+\z"),
        "phone": F.length(F.regexp_replace(text, "[^0-9]", "")) >= 10,
        "zip": text.rlike(r"^[0-9]{5}(?:-[0-9]{4})?\z"),
        "state": text.rlike(r"(?i)^[A-Z]{2}\z"),
        "location_code": F.length(identity_col(text)) >= 3 if field == "location_code" else None,
        "franchisee_entity": text.rlike(P.ENTITY_WORD),
    }
    good = tests.get(field)
    value = F.lit(2) if good is None else F.when(good, 4).otherwise(3 if field == "franchisee_entity" else 2)
    return F.when(meaningful(c), value).otherwise(0)
