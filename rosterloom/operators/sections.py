"""Lists in long documents: headings, table of contents, footers, and the page range of each list.

The rules take plain page texts, so that they run per document inside a grouped
plan (``discover``) and by themselves.  Whether one line is a heading, and which
status it sets, exists as a column expression too (``functions.fields``).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from ..functions import patterns as P
from ..functions.text import rx, squash
from .grouped import map_groups

#: Pages on which a table of contents may stand, and lines of a page that may hold its label.
TOC_PAGES = 25
FOOTER_LINES = 6

STATUS_OF_KIND = {"current": "Current", "former": "Former", "signed-but-not-open": "Planning"}
SECTION_SCHEMA = (
    "document_id string, ordinal long, heading string, kind string, status string, exhibit string, printed_start int, printed_end int, pdf_start int, pdf_end int, from_toc boolean"
)

_KINDS = ((P.BOTH_LISTS, None), (P.PLANNED_LIST, "signed-but-not-open"), (P.FORMER_LIST, "former"), (P.CURRENT_LIST, "current"))
_HEADINGS = ((P.PLANNED_HEADING, "Planning"), (P.FORMER_HEADING, "Former"), (P.CURRENT_HEADING, "Current"))
_REFUSED = ("^[a-z]", "^[0-9]+ +[A-Za-z]", P.DOTTED_RANGE_TAIL, r"(?i)table of contents|item 20 *[-–—:]? *\z")
_PREFIXES = (r"(?i)^(?:EXHIBIT|EX\.) *[A-Z0-9-]+ *[-–—:]? *", r"(?i)^[A-Z] *- *[0-9]+ *[-.)–—:] *", r"(?i)^[A-Z][0-9]? *[-.)–—:] *", rf"(?i)^[A-Z][0-9]? +(?=LIST{P.EDGE})")
_ITEM = rf"(?i){P.EDGE}ITEM *(20){P.EDGE}"
_TOC_SHAPES = (r"\.{2,}", rf"(?i)^(?:(?:EXHIBIT|EX\.) *[A-Z0-9-]+|[A-Z][0-9]){P.EDGE}")


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def list_kind(line: str) -> str | None:
    line = squash(line)
    return next((kind for pattern, kind in _KINDS if rx(pattern).search(line)), None)


def heading_kind(line: str) -> str | None:
    line = squash(line)
    if not line or len(line) > 180 or any(rx(p).search(line) for p in _REFUSED):
        return None
    core = line
    for prefix in _PREFIXES:
        core = rx(prefix).sub("", core, count=1)
    core = core.strip(" ")
    return list_kind(core) if rx(P.LIST_START).search(core) else None


def heading_status(line: str) -> str | None:
    line = squash(line).upper()
    return next((status for pattern, status in _HEADINGS if rx(pattern).search(line)), None)


def final_status(text: str, status: str = "Current") -> str:
    """The status after all lines of a page."""
    for line in _lines(text):
        status = heading_status(line) or status
    return status


@dataclass(frozen=True)
class TocEntry:
    title: str
    item: int | None
    exhibit: str | None
    first: int | None
    last: int | None
    kind: str | None

    @property
    def spans(self) -> bool:
        """Whether a range of several pages is given."""
        return self.first != self.last


def toc_entries(text: str) -> list[TocEntry]:
    """Entries of a table of contents that name Item 20 or a list."""
    found = []
    for line in map(squash, _lines(text)):
        kind, item = list_kind(line), rx(_ITEM).search(line)
        if not (kind or item):
            continue
        starts = item is not None and item.start() == 0
        if not (starts or any(rx(p).search(line) for p in _TOC_SHAPES) or heading_kind(line)):
            continue
        tail, exhibit = rx(P.RANGE_TAIL).search(line), rx(rf"(?i){P.EDGE}(?:EXHIBIT|EX\.) *([A-Z0-9-]+){P.EDGE}").search(line)
        first, last = (int(tail[1]), int(tail[2] or tail[1])) if tail else (None, None)
        found.append(TocEntry((line[: tail.start()] if tail else line).strip(" "), 20 if item else None, exhibit[1] if exhibit else None, first, last, kind))
    return found


def footer_label(text: str) -> int | None:
    labels = rx(P.FOOTER_LABEL).findall(" ".join(_lines(text)[-FOOTER_LINES:]))
    return int(labels[-1]) if labels else None


def printed_pages(pages: Iterable[tuple[int, str]]) -> dict[int, int]:
    """Printed label to page; of several pages with one label the last counts."""
    return {label: page for page, text in pages if (label := footer_label(text)) is not None}


@dataclass(frozen=True)
class Heading:
    page: int
    text: str
    kind: str
    exhibit: str | None

    @property
    def key(self) -> tuple:
        return self.kind, self.exhibit


@dataclass
class Section:
    heading: str
    kind: str
    status: str
    exhibit: str | None
    printed_start: int | None
    printed_end: int | None
    pdf_start: int
    pdf_end: int


@dataclass
class Discovery:
    toc: list[TocEntry] = field(default_factory=list)
    sections: list[Section] = field(default_factory=list)
    printed: dict[int, int] = field(default_factory=dict)

    @cached_property
    def _labels(self) -> dict[int, int]:
        """The first label of each page."""
        return {page: label for label, page in reversed(self.printed.items())}

    def printed_page(self, page: int, section: Section) -> int | None:
        """The label of a page, or its place counted from the section's first label."""
        own = self._labels.get(page)
        if own is not None:
            return own
        return section.printed_start + page - section.pdf_start if section.printed_start and section.pdf_start else None


def _scan(pages: list[tuple[int, str]]) -> tuple[list[Heading], list[tuple[int, str]]]:
    """Headings, each with the exhibit that holds there, and the starts of exhibits."""
    headings, exhibits, exhibit = [], [], None
    for page, text in pages:
        credible = page > TOC_PAGES or rx(P.EVIDENCE).search(text) is not None
        lines = [squash(x) for x in _lines(text)]
        for line, following in zip(lines, [*lines[1:], ""], strict=True):
            if start := rx(P.EXHIBIT_LINE).search(line):
                exhibit = start[1]
                exhibits.append((page, exhibit))
            alone = rx(r"(?i)^(?:EXHIBIT(?![A-Za-z0-9_])|EX\.) *[A-Z0-9-]+ *\z").search(line)
            joined = "" if alone else f"{line} {following}".strip(" ")
            heading = next((x for x in (line, joined) if heading_kind(x)), None)
            if heading and credible:
                short = rx(r"(?i)^([A-Z]-[0-9]+) *:").search(heading)
                headings.append(Heading(page, heading, heading_kind(heading), short[1] if short else exhibit))
    return headings, exhibits


def discover_sections(pages: Iterable[tuple[int, str]]) -> Discovery:
    """Sections of a document from (page, text), with their page ranges."""
    pages = sorted(pages)
    numbers = [p for p, _ in pages]
    printed = printed_pages(pages)
    label_of = {p: label for label, p in printed.items()}
    toc = toc_entries("\n".join(text for p, text in pages if p <= TOC_PAGES))
    headings, exhibits = _scan(pages)
    out, seen = Discovery(toc=toc, printed=printed), set()
    for k, h in enumerate(headings):
        if h.key in seen:
            continue  # a repeated heading continues its list
        seen.add(h.key)
        entry = next((t for t in toc if (t.kind, t.exhibit) == h.key), None)
        limits = [next((x.page for x in headings[k + 1 :] if x.key != h.key), None), next((p for p, name in exhibits if p > h.page and name != h.exhibit), None)]
        limits = [x for x in limits if x is not None]
        last = bisect_left(numbers, min(limits)) - 1 if limits else len(numbers) - 1
        runs_to = numbers[max(bisect_left(numbers, h.page), last)]
        start = entry.first if entry and entry.first is not None else label_of.get(h.page)
        explicit = entry is not None and entry.spans
        mapped = printed.get(entry.last) if explicit else None
        out.sections.append(
            Section(
                h.text, h.kind, STATUS_OF_KIND[h.kind], h.exhibit,
                start, entry.last if explicit else label_of.get(runs_to, start),
                printed.get(start, h.page) if start else h.page, mapped if mapped and mapped >= h.page else runs_to,
            )
        )
    return out


def _sections_of(rows: list[dict]) -> list[dict]:
    found = discover_sections((r["pdf_page"], r["text"] or "") for r in rows)
    head = {"document_id": rows[0]["document_id"], "from_toc": any(t.kind for t in found.toc)}
    return [head | {"ordinal": k} | asdict(s) for k, s in enumerate(found.sections)]


def discover(pages: DataFrame) -> DataFrame:
    """Sections of each document in ``pages`` (document_id, pdf_page, text), in order.

    A task holds one document's page texts at a time, which the page limit of a document bounds.
    """
    return map_groups(pages.select("document_id", "pdf_page", "text"), ["document_id"], ["pdf_page"], _sections_of, SECTION_SCHEMA)
