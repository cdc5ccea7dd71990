"""Contacts: person names, contacts of a candidate, their identity, and merged lists."""

from __future__ import annotations

import re

from ..functions import patterns as P
from ..functions.text import identity, is_meaningful, rx
from ..schema import CONTACT_FIELDS


def _bare(name: str) -> str:
    return rx(rf"\*+\z").sub("", rx(rf"^[0-9]+[.)]?{P.S}*").sub("", name)).strip(P.SPACE)


def is_person(name: str | None) -> bool:
    """Two to five words of letters, without business words, numbers or addresses."""
    if not name or rx(rf"^{P.S}*[0-9]+{P.S}+[A-Za-z]").search(name):
        return False
    bare = _bare(name)
    if not bare or rx(P.BUSINESS_WORD).search(bare):
        return False
    words = bare.replace(",", " ").split()
    return 2 <= len(words) <= 5 and all(rx(r"^[A-Za-z.'’-]+\z").search(w) for w in words)


def split_name(name: str) -> dict[str, str | None]:
    """First, middle and last name and suffix, of either order."""
    tail = rx(rf"(?i){P.EDGE}(Jr\.?|Sr\.?|II|III|IV){P.S}*\z").search(name)
    rest = name[: tail.start()].strip(P.SPACE) if tail else name
    if "," in rest:
        last, given = (x.strip(P.SPACE) for x in rest.split(",")[:2])
        words = given.split()
        parts = words[:1], words[1:], [last] if last else []
    else:
        words = rest.split()
        parts = words[:1], words[1:-1], words[1:][-1:]
    joined = [" ".join(p) or None for p in parts]
    return {"first_name": joined[0], "middle_name": joined[1], "last_name": joined[2], "suffix": tail[1] if tail else None}


def contacts_of(entity: str | None, raw: str | None, phone: str | None, email: str | None) -> list[dict]:
    """The contact of a candidate: its entity if that is a person, else the first person in its source text."""
    name = _bare(entity) if is_person(entity) else next((x for part in (raw or "").split("|") if is_person(x := part.strip(P.SPACE))), None)
    if not (name or phone or email):
        return []
    return [dict.fromkeys(CONTACT_FIELDS) | {"raw_name": name, "phone": phone, "email": email} | (split_name(name) if name else {})]


def contact_identity(contact: dict) -> tuple[str, str, str]:
    """Comparable email, phone and name."""
    digits = re.sub("[^0-9]", "", contact.get("phone") or "")
    name = contact.get("raw_name")
    if name is None:
        name = " ".join(filter(None, (contact.get(k) for k in ("first_name", "middle_name", "last_name", "suffix"))))
    return identity(contact.get("email")).replace(" ", ""), digits[-10:], identity(name)


def same_contact(a: dict, b: dict) -> bool:
    (email_a, phone_a, name_a), (email_b, phone_b, name_b) = contact_identity(a), contact_identity(b)
    if email_a and email_a == email_b:
        return True
    if name_a and name_b and phone_a and phone_b:
        return (name_a, phone_a) == (name_b, phone_b)
    if phone_a and phone_a == phone_b:
        return not (name_a or name_b or email_a or email_b)
    return bool(name_a) and name_a == name_b and not (email_a or email_b or phone_a or phone_b)


def merge_contacts(stored: list[dict], incoming: list[dict]) -> tuple[list[dict], bool]:
    """Both lists with like contacts joined, missing fields filled, and whether that differs from ``stored``."""
    merged: list[dict] = []
    for contact in (*stored, *incoming):
        like = next((m for m in merged if same_contact(m, contact)), None)
        if like is None:
            merged.append(dict(contact))
        else:
            like.update({k: contact.get(k) for k in CONTACT_FIELDS if not is_meaningful(like.get(k)) and is_meaningful(contact.get(k))})
    return merged, merged != stored
