"""Record grammars: table rows, contact directories, territory, unit and address blocks.

Each takes the cells of a row or the lines of a column and gives candidates as
dictionaries.  Block grammars are sequential: they read lines with markers of
page and status between them, as ``marked_lines`` makes them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from ..functions import patterns as P
from ..functions.text import first, rx, squash
from .sections import heading_status

#: Fields of a candidate that a grammar fills, and confidences and notes by grammar.
FIELDS = ("status", "franchisee_entity", "address", "city", "state", "zip", "phone", "email", "source_page", "raw_source_text", "confidence", "review_reason")
TABLE = (0.64, "Automatically extracted from PDF layout")
CONTACTS = (0.58, "The FDD identifies a franchisee or territory but does not disclose a street address")
TERRITORIES = (0.52, "The FDD identifies a franchise territory or agreement code without a normalized street address")
UNITS = (0.68, "Automatically extracted from a franchise territory block")
ADDRESSES = (0.66, "Automatically extracted from a multiline franchisee address block")
OPEN_TERRITORY = (0.58, "FDD lists the franchise territory but does not disclose a street address")
HISTORY = 8

_STATE_CODES = {name.lower(): code for name, code in P.US_STATES.items()}
_ZIP_START = r"^([0-9]{5}(?:-[0-9]{4})?)(?: |\z)"
_COUNTER = r"^ *[0-9]+[.)]? *"
_LEGAL_NAME = rf"(?i)^(.+?{P.EDGE}(?:L\.? *L\.? *C\.?|I\.? *N\.? *C\.?|INCORPORATED|CORP(?:ORATION)?\.?|LTD\.?|LIMITED|L\.? *P\.?|L\.? *L\.? *P\.?|LLP|COMPANY|CO\.?)){P.EDGE}"
_LABEL_CELL = r"(?i)^(?:store|location|number|no\.?|#|primary contact|phone|email)\z"
_COUNTER_CELL = r"(?i)^(?:[0-9]+[.)]?|store|location|number|no\.?|#)\z"
_DIRECTORY_LABEL = r"(?i)^(?:former studio|studio territory|state|franchisee|primary contact|phone|location)\z"
_NOT_A_NAME = r"(?i)franchise|disclosure|document|location|code|email|phone|outlet|note|DMA"


def state_code(text: str) -> str:
    return text.upper() if rx(r"(?i)^[A-Z]{2}\z").search(text) else _STATE_CODES.get(text.lower(), text)


def _candidate(grammar: tuple[float, str], **values) -> dict:
    return dict.fromkeys(FIELDS) | {"confidence": grammar[0], "review_reason": grammar[1]} | values


def _contacts(text: str) -> dict:
    return {"phone": first(P.PHONE, text), "email": first(P.EMAIL, text)}


# ------------------------------------------------------------------ rows of cells


def _position(cells: list[str], pattern: str) -> int:
    return next((k for k, c in enumerate(cells) if rx(pattern).search(c)), -1)


def directory_row(cells: list[str], page: int, status: str) -> dict | None:
    """A row of state, name and contact details without a street."""
    at = _position(cells, P.STATE_ONLY)
    if not 0 <= at <= 2 or len(cells) < 3:
        return None
    k = 0 if at == 2 else at + 1
    entity = cells[k] if k < len(cells) else ""
    raw = " | ".join(cells)
    contacts = _contacts(raw)
    if not entity or rx(_DIRECTORY_LABEL).search(entity) or not any(contacts.values()):
        return None
    city = P.NO_CITY if at == 0 else cells[at - 1]
    return _candidate(CONTACTS, status=status, franchisee_entity=entity, address=P.NO_ADDRESS, city=city, state=state_code(cells[at]), zip="", source_page=page, raw_source_text=raw, **contacts)


def _row_entity(before: list[str], after: list[str]) -> str | None:
    """The first company name of a row, else what stands before the address."""
    details = [squash(rx(P.EMAIL).sub(" ", rx(P.PHONE).sub(" ", rx(r"^[0-9]{5}(?:-[0-9]{4})? *").sub("", c)))) for c in after]
    names = [rx(_COUNTER).sub("", c).strip(" ") for c in (*before, *details)]
    legal = [m[1].strip(" ") for c in names if c and not rx(_LABEL_CELL).search(c) and (m := rx(_LEGAL_NAME).search(c))]
    if legal:
        return legal[0]
    return rx(_COUNTER).sub("", " ".join(c for c in before if not rx(_COUNTER_CELL).search(c))).strip(" ") or None


def table_row(cells: Iterable[str], page: int, status: str) -> dict | None:
    """A row with street, city, state and ZIP; else a directory row; else None."""
    cells = [c for c in map(squash, cells) if c]
    at = _position(cells, P.STATE_ONLY)
    if at < 2:
        at = _position(cells, P.STATE_ZIP)
    if at < 2:
        return directory_row(cells, page, status)
    packed, whole = rx(P.STATE_ZIP).search(cells[at]), rx(P.CITY_STATE_ZIP_CELL).search(cells[at])
    street_at = at - 1 if whole else at - 2
    city = whole[1].strip(" ") if whole else cells[at - 1]
    zips = (m[1] for c in cells[at + 1 :] if (m := rx(_ZIP_START).search(c)))
    code = whole[3] if whole else packed[2] if packed else next(zips, None)
    street = cells[street_at]
    if not (rx("[0-9]").search(street) and city and code):
        return directory_row(cells, page, status)
    raw = " | ".join(cells)
    planned = rx(rf"(?i)not yet opened|{P.EDGE}TBD{P.EDGE}").search(raw)
    return _candidate(
        TABLE, status="Planning" if planned else status, franchisee_entity=_row_entity(cells[:street_at], cells[at + 1 :]), address=street, city=city,
        state=state_code(packed[1] if packed else cells[at]), zip=code, source_page=page, raw_source_text=raw, **_contacts(raw),
    )


# ------------------------------------------------------------------ blocks of lines


def marked_lines(pages: Iterable[tuple[int, str, str, list[str]]]) -> list[str]:
    """Lines of one column over (page, status, heading, lines), with markers before each page's."""
    return [x for page, status, heading, lines in pages for x in (f"[[PAGE:{page}]]", f"[[STATUS:{status}]]", heading, *lines)]


def _events(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """("page", number), ("status", name) and ("line", text)."""
    for raw in lines:
        line = squash(raw)
        if m := rx(r"^\[\[PAGE:([0-9]+)\]\]\z").search(line):
            yield "page", m[1]
        elif m := rx(r"^\[\[STATUS:(Current|Former|Planning)\]\]\z").search(line):
            yield "status", m[1]
        elif line:
            yield "line", line


def territory_blocks(lines: Iterable[str], page: int) -> list[dict]:
    """A candidate for each agreement code of a block, under the state that heads it."""
    out, block, status, state = [], [], "Current", None
    for kind, value in _events(lines):
        changed = heading_status(value) if kind == "line" else None
        if kind == "page":
            page = int(value)
        elif kind == "status":
            status = value
        elif changed and changed != status:
            status = changed
        elif rx(P.STATE_ONLY).search(value):
            state = state_code(value)
        else:
            block.append(value)
            codes = rx(rf"{P.EDGE}([A-Z]{{2}}[0-9]{{4}}){P.EDGE}").findall(value)
            if not (codes and state):
                continue
            out += [_territory(block, status, state, page, code) for code in codes]
        block = []
    return out


def _territory(block: list[str], status: str, state: str, page: int, code: str) -> dict:
    raw = " | ".join(block)
    mended = rx(rf"(?i)(\.[A-Z]) +([A-Z]{{1,2}})(?={P.EDGE}|[;|])").sub(r"\1\2", raw)
    mended = rx(" +@ *").sub("@", mended)
    areas = [rx(rf"(?i) +DMA{P.EDGE}.*\z").sub("", x).strip(" ") for x in block if rx(rf"(?i){P.EDGE}DMA{P.EDGE}").search(x)]
    names = [x for x in block if rx(P.SHORT_ENTITY_END).search(x)] or [x for x in block if rx(r"^[A-Za-z][A-Za-z&'’. -]{2,}\z").search(x) and not rx(_NOT_A_NAME).search(x)]
    return _candidate(
        TERRITORIES, status=status, franchisee_entity=names[0] if names else None, address=P.NO_ADDRESS, city=areas[-1] if areas else P.NO_TERRITORY, state=state, zip="",
        source_page=page, raw_source_text=f"{raw} | Location code: {code}", **_contacts(mended),
    )


def _last(values: list[str], test, before: int | None = None) -> int:
    return next((k for k in range((len(values) if before is None else before) - 1, -1, -1) if test(values[k])), -1)


def unit_blocks(lines: Iterable[str], page: int) -> list[dict]:
    """A candidate for each of the last N territories of a block that ends in "# of units: N"."""
    out, block, status = [], [], "Current"
    for kind, value in _events(lines):
        changed = heading_status(value) if kind == "line" else None
        if kind == "page":
            page = int(value)
        elif kind == "status":
            status = value
        elif changed and changed != status:
            status, block = changed, []
        elif units := rx(r"(?i)^# *of +units: *([0-9]+)\z").search(value):
            out += _units(block, value, int(units[1]), status, page)
            block = []
        else:
            block.append(value)
    return out


def _units(block: list[str], line: str, count: int, status: str, page: int) -> list[dict]:
    mailing_at = _last(block, rx(P.CITY_STATE_ZIP).search)
    if mailing_at < 0:
        return []
    mailing = rx(P.CITY_STATE_ZIP).search(block[mailing_at])
    street_at = _last(block, lambda x: rx("[0-9]").search(x) and not rx(r"^[0-9]{3}[-. ][0-9]{3}").search(x), mailing_at)
    plain = lambda x: not (rx(P.TERRITORY).search(x) or rx(P.CITY_STATE_ZIP).search(x) or (x.lower() in _STATE_CODES and x.lower() != "district of columbia"))
    owner_at = _last(block, plain, max(street_at, 0))
    # without a street line the block's last line is left out, as counting from the end does
    stop = owner_at if owner_at >= 0 else street_at
    territories = [m for x in block[:stop] if (m := rx(P.TERRITORY).search(x))]
    places = [(m[0], m[1], m[2]) for m in territories[-count:]] or [(mailing[0], mailing[1], mailing[2])]
    return [
        _candidate(
            UNITS, status=status, franchisee_entity=block[owner_at] if owner_at >= 0 else None, address=block[street_at] if street_at >= 0 else "Address not listed", city=city.strip(" "), state=state.upper(), zip=mailing[3],
            source_page=page, raw_source_text=" | ".join([*block, line, f"Territory: {name}"]),
        )
        for name, city, state in places
    ]


class _AddressReader:
    """Streets of several lines inside a list: a short history of lines, and the candidate that details join."""

    def __init__(self, page: int) -> None:
        self.page, self.status, self.inside = page, "Current", False
        self.history: list[str] = []
        self.found: list[dict] = []
        self.open: dict | None = None

    def _restart(self, inside: bool) -> None:
        self.inside, self.history, self.open = inside, [], None

    def _emit(self, grammar: tuple[float, str], **values) -> None:
        self.open = _candidate(grammar, status=self.status, source_page=self.page, **values)
        self.found.append(self.open)
        self.history = []

    def line(self, line: str) -> None:
        if rx(rf"(?i)^EXHIBIT +[A-Z0-9-]+{P.EDGE}").search(line):
            self._restart(False)
            return
        self.status = heading_status(line) or self.status
        if rx(P.LOCATION_LIST).search(line):
            self._restart(True)
        elif self.inside:
            self._inside(line)

    def _inside(self, line: str) -> None:
        place, contacts = rx(P.ADDRESS_LINE).search(line), _contacts(line)
        if place:
            self._address(line, place, contacts)
        elif any(contacts.values()):
            self._details(line, contacts)
        else:
            self.history = [*self.history, line][-HISTORY:] if len(self.history) <= HISTORY else [*self.history, line][1:]

    def _details(self, line: str, contacts: dict) -> None:
        if self.open and self.open["source_page"] == self.page:
            self.open.update({k: v for k, v in contacts.items() if v})
            self.open["raw_source_text"] += f" | {line}"
            return
        at = _last(self.history, rx(P.TERRITORY).search)
        rest = self.history[at + 1 :] if at >= 0 else []
        if len(rest) != 1 or rx(P.TERRITORY).search(rest[0]):
            return
        territory = rx(P.TERRITORY).search(self.history[at])
        raw = " | ".join([*self.history[at:], line])
        self._emit(OPEN_TERRITORY, franchisee_entity=rest[0].rstrip("*").strip(" "), address=P.NO_ADDRESS, city=territory[1].strip(" "), state=territory[2].upper(), zip="", raw_source_text=raw, **contacts)

    def _address(self, line: str, place, contacts: dict) -> None:
        inline = (place[1] or "").strip(" ")
        street_at = _last(self.history, lambda x: rx("[0-9]").search(x) and not rx(r"^\(?[0-9]{3}\)?[-. ][0-9]{3}").search(x))
        street = inline if rx("[0-9]").search(inline) else self.history[street_at] if street_at >= 0 else ""
        street = rx("^[A-Z]{2} +(?=[0-9])").sub("", street).strip(" ")
        if not street:
            self.history.append(line)
            return
        named = lambda x: not (rx("[0-9]").search(x) or rx(P.TERRITORY).search(x) or rx(P.LOCATION_LIST).search(x) or x.lower() in _STATE_CODES)
        owner_at = _last(self.history, named, len(self.history) if inline else max(street_at, 0))
        owner = self.history[owner_at].rstrip("*").strip(" ") if owner_at >= 0 else None
        raw = " | ".join([*self.history[max(0, owner_at) :], line])
        self._emit(ADDRESSES, franchisee_entity=owner, address=street, city=place[2].strip(" "), state=state_code(place[3]), zip=place[4], raw_source_text=raw, **contacts)


def address_blocks(lines: Iterable[str], page: int) -> list[dict]:
    """Candidates from addresses over several lines, inside list headings only."""
    reader = _AddressReader(page)
    for kind, value in _events(lines):
        if kind == "page":
            reader.page = int(value)
        elif kind == "status":
            reader.status = value
        else:
            reader.line(value)
    return reader.found
