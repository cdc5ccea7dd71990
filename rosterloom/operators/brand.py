"""The brand of a document, from its file name and its first pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import rx, squash
from ..session import SHUFFLED

#: Fixed value: pages that may name the brand.
BRAND_PAGES = 5


def known_brand(text: str) -> str | None:
    return next((name for pattern, name in P.BRANDS if rx(pattern).search(text)), None)


def brand_value(text: str) -> str:
    text = rx(r"[.,;:]+\z").sub("", squash(text)).strip(" ")
    if not text or rx(P.INVALID_BRAND).search(text):
        return ""
    return known_brand(text) or text


def labelled_brand(page: str) -> str:
    """The name after the word "franchisor" on a page, up to its legal form or the end of the sentence."""
    label = rx(P.BRAND_LABEL).search(page)
    if not label:
        return ""
    value = rx(rf"(?i){P.S}+(?:a|an){P.S}+[A-Z][A-Z]+{P.EDGE}.*\z").sub("", label[1], count=1).strip(P.SPACE)
    legal = rx(P.BRAND_ENTITY_END).search(value)
    value = value[: legal.end()] if legal else rx(rf"[.;](?:{P.S}|\z)").split(value, maxsplit=1)[0]
    if not rx("^[A-Za-z0-9]").search(value):
        return ""
    value = brand_value(value)
    return "" if rx(r"(?i)^(?:at|a|an|the|we|us|our|it|its)\z").search(value) else value


def detect_brand(page: str, fallback: str) -> str:
    """A known brand of the fallback, else of the page, else a telling fallback, else a labelled name."""
    own = brand_value(fallback)
    known = known_brand(own) or known_brand(page)
    if known:
        return known
    if own and not rx(P.GENERIC_BRAND).search(own):
        return own
    return labelled_brand(page) or own or fallback


def document_brands(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id and brand: detection folded over the first pages, from the file name's brand on."""
    from ..functions.fields import brand_from_filename

    first = pages.filter(F.col("pdf_page") <= BRAND_PAGES).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pdf_page", "text"))).alias("p"))
    rows = documents.select("document_id", brand_from_filename(F.col("filename")).alias("start")).join(first.hint(SHUFFLED), "document_id", "left")

    def fold(starts: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for brand, pages_of in zip(starts, texts, strict=True):
            for page in pages_of if pages_of is not None else ():
                brand = detect_brand(page or "", brand)
            out.append(brand)
        return pd.Series(out, dtype=object)

    return rows.select("document_id", F.pandas_udf(fold, "string")("start", F.col("p.text")).alias("brand"))
