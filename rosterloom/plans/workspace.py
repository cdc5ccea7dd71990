"""The workspace's operations over stored tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..operators import directory, grams
from ..schema import CONTACT_FIELDS, DOCUMENTS, SEARCHED
from ..sources.documents import disposition
from ..sources.store import SnapshotStore
from .process import NUMBERS, VISIBLE, document_scopes

#: What a search may ask for, and fields that a patch may change.
LOCATION_STATUS = ("Current", "Former", "Planning")
REVIEW_STATUS = ("Needs review", "Auto-verified", "Approved", "Rejected")
PATCHABLE = ("status", "franchisee_entity", "address", "city", "state", "zip", "phone", "email", "review_status", "exit_reason")


@dataclass(frozen=True)
class Search:
    """Search parameters; values come as text or numbers and are checked here."""

    q: str | None = None
    status: str | None = None
    franchisor: str | None = None
    state: str | None = None
    document_id: str | None = None
    review_status: str | None = None
    limit: int = 100
    offset: int = 0

    def __post_init__(self) -> None:
        for name in ("limit", "offset"):
            object.__setattr__(self, name, int(getattr(self, name)))
        if not 1 <= self.limit <= 500 or self.offset < 0:
            raise ValueError("limit must be from 1 to 500, and offset not negative")
        if self.status not in (None, *LOCATION_STATUS) or self.review_status not in (None, *REVIEW_STATUS):
            raise ValueError("unknown status")


class Workspace:
    """Queries and changes over a ``SnapshotStore``."""

    def __init__(self, store: SnapshotStore) -> None:
        self.store = store

    def _visible(self) -> DataFrame:
        return self.store.read("documents").filter(F.col("processing_status").isin(*VISIBLE)).select(F.col("id").alias("document_id"))

    def stats(self) -> DataFrame:
        """Documents, and locations of visible ones in all, by status and to be reviewed, from the sums that changes keep up."""
        version = self.store.version()
        d = self.store.read("documents", version).select(F.col("id").alias("document_id"), F.col("processing_status").isin(*VISIBLE).alias("visible"))
        sums = d.join(self.store.tallies(version), "document_id", "left")
        tests = {"total_locations": F.lit(True), **{f"{s.lower()}_locations": F.col("status") == s for s in LOCATION_STATUS}, "needs_review": F.col("review_status") == "Needs review"}
        total = lambda test: F.coalesce(F.sum(F.when(F.col("visible") & test, F.col("n"))), F.lit(0)).cast("long")
        return sums.agg(F.count_distinct("document_id").alias("documents"), *(total(test).alias(name) for name, test in tests.items()))

    def documents(self) -> DataFrame:
        """Documents, newest first, with counts by status, their sum, and stages in order."""
        by_status = self.store.tallies().groupBy("document_id", "status").agg(F.sum("n").alias("n")).filter("n > 0")
        counts = by_status.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("record_counts"))
        docs = self.store.read("documents").withColumn("document_id", F.col("id"))
        out = directory.with_children(docs, self.store.read("stages"), "document_id", "stages").join(counts, "document_id", "left")
        total = F.aggregate(F.coalesce(F.map_values("record_counts"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, n: a + n)
        iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
        out = out.withColumns({"location_count": total, "record_counts": F.coalesce("record_counts", F.create_map().cast("map<string,bigint>"))})
        times = ("upload_date", "last_processed_at", "created_at")
        return out.orderBy(F.desc("upload_date"), "id").select(*(iso(c) if c in times else c for c in out.columns if c != "document_id"))

    def latest_stages(self) -> DataFrame:
        return directory.latest(self.store.read("stages"), "document_id", ["id"])

    def filter_documents(self, term: str) -> DataFrame:
        return self.store.read("documents").filter(directory.contains_any(term, ["franchise_name", "filename"]))

    def search(self, search: Search) -> DataFrame:
        """One page of locations; a pinned document is shown whatever its status.

        A term's postings say which ids can match and in which buckets they are; only those
        buckets are read, and what is found is tested.
        """
        version = self.store.version()
        if search.q and (found := self.store.postings(search.q, version)) is not None:
            found = self.store.aside(found.select("at.*"), f"found-{uuid.uuid4().hex}")
            buckets = [r[0] for r in found.select("held_in").distinct().collect()]
            rows = self.store.read("locations", version, buckets).join(found.select("id"), "id", "left_semi")
        else:
            rows = self.store.read("locations", version)
        if search.q:
            rows = rows.filter(grams.matches_any(search.q, list(SEARCHED)))
        equals = {k: getattr(search, k) for k in ("status", "franchisor", "state", "document_id", "review_status")}
        rows = directory.restrict(rows, equals, None if search.document_id else self._visible())
        found = directory.page(rows, ["franchise_name", "state", "city"], "id", search.limit, search.offset)
        return found.withColumn("contacts", F.array().cast(f"array<struct<{','.join(f'{c}:string' for c in CONTACT_FIELDS)}>>")).withColumn("source_document_filename", F.lit(None).cast("string"))

    def location(self, location_id: str) -> DataFrame:
        """One location with its contacts and its document's file name; no row if there is none.

        The id's posting names the bucket, and only that is read.
        """
        version = self.store.version()
        buckets = self.store.holders(location_id, version)
        row = self.store.read("locations", version, buckets).filter(F.col("id") == location_id).limit(1)
        people = self.store.read("contacts", version, buckets).filter(F.col("location_id") == location_id).select(F.col("location_id").alias("id"), *CONTACT_FIELDS)
        names = self.store.read("documents", version).select(F.col("id").alias("document_id"), F.col("filename").alias("source_document_filename"))
        return directory.with_children(row, people, "id", "contacts").join(names, "document_id", "left")

    def franchisors(self) -> DataFrame:
        return directory.facet(self.store.read("locations").withColumn("name", F.coalesce(F.nullif("franchisor", F.lit("")), "franchise_name")), "name")

    def display_rows(self, locations: DataFrame) -> DataFrame:
        """Names with their fallback, whole percentages, page links, and exit reasons of former rows only."""
        return locations.withColumns({
            "display_name": F.coalesce(F.nullif("franchisor", F.lit("")), "franchise_name"), "confidence_percent": F.floor(F.col("confidence") * 100 + 0.5),
            "source_link": F.concat(F.lit("/documents/"), "document_id", F.lit("/pdf#page="), F.col("source_page").cast("string")), "shown_exit_reason": F.when(F.col("status") == "Former", F.col("exit_reason")),
        })

    def patch(self, location_id: str, changes: dict[str, str | None]) -> DataFrame:
        """Changes the known fields given, by null too, and returns the row; unknown fields are dropped."""
        known = {k: v for k, v in changes.items() if k in PATCHABLE}
        if not known:
            raise ValueError("nothing to change")
        if known.get("status", "Current") not in LOCATION_STATUS or known.get("review_status", "Approved") not in REVIEW_STATUS:
            raise ValueError("unknown status")
        row = [(location_id, list(known), *(known.get(c) for c in PATCHABLE))]
        patches = self.store.spark.createDataFrame(row, "id string, present array<string>, " + ", ".join(f"{c} string" for c in PATCHABLE))

        def change(base: int) -> None:
            rows = self.store.read("locations", base, self.store.holders(location_id, base)).filter(F.col("id") == location_id)
            if not (brands := self.store.touched(rows, "franchisor")):
                raise KeyError(location_id)
            patched = directory.patch_rows(rows, patches, "id", list(PATCHABLE))
            self.store.change(base, [f"brand/{b}" for b in brands], locations=patched.withColumn("updated_at", F.current_timestamp()))

        self.store.attempt(change)
        return self.location(location_id)

    def register(self, uploads: DataFrame) -> None:
        """Uploads (filename, object_path): known file names are replaced, new ones inserted; each gets a stage."""
        self.store.attempt(lambda base: self._register(uploads, base))

    def _register(self, uploads: DataFrame, base: int) -> None:
        now = F.current_timestamp()
        newest = uploads.groupBy("filename").agg(F.max("object_path").alias("new_path"))
        joined = newest.join(self.store.read("documents", base), "filename", "left")
        fresh = F.col("id").isNull()
        keyed = joined.withColumns({
            "franchise_name": F.when(fresh, fields.upload_name(F.col("filename"))).otherwise(F.col("franchise_name")), "fdd_year": F.when(fresh, fields.upload_year(F.col("filename"))).otherwise(F.col("fdd_year")),
            "object_path": F.coalesce("new_path", "object_path"), "upload_date": now, "processing_status": F.lit("Processing"),
            "page_count": F.coalesce("page_count", F.lit(0)), "published_counts": F.coalesce("published_counts", F.create_map().cast("map<string,bigint>")), "created_at": F.coalesce("created_at", now),
            "id": F.coalesce("id", F.sha2("filename", 256)),
        })
        keyed = self.store.aside(keyed.select(*(x.strip().split(" ")[0] for x in _columns(DOCUMENTS))), f"uploads-{uuid.uuid4().hex}")
        first = self.store.read("stages", base).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        numbered = directory.number_rows(keyed.select(F.col("id").alias("document_id")), "document_id", first)
        new = numbered.select("id", "document_id", F.lit("Upload").alias("stage"), F.lit("Complete").alias("status"), F.lit(None).cast("string").alias("message"), now.alias("started_at"), now.alias("finished_at"))
        self.store.change(base, {NUMBERS} | document_scopes(self.store, keyed), documents=keyed, stages=new)

    def rerun(self, ids: DataFrame) -> DataFrame:
        """For each requested id: 404 unknown, 409 without a source or being processed, else 202 and set to Processing."""
        return self.store.attempt(lambda base: self._rerun(ids, base))

    def _rerun(self, ids: DataFrame, base: int) -> DataFrame:
        docs = self.store.read("documents", base)
        found = ids.select("id").distinct().join(docs.select("id", "object_path", "processing_status"), "id", "left")
        code = F.when(F.col("processing_status").isNull(), 404).when(F.coalesce(F.col("object_path"), F.lit("")) == "", 409).when(F.col("processing_status") == "Processing", 409).otherwise(202)
        answers = self.store.aside(found.select("id", code.alias("code")), f"answers-{uuid.uuid4().hex}")
        changed = docs.join(answers.filter("code = 202").select("id"), "id", "left_semi").withColumn("processing_status", F.lit("Processing"))
        self.store.change(base, document_scopes(self.store, changed), documents=changed)
        return answers

    def finish_stage(self, stage_id: int, status: str, message: str | None = None) -> None:
        def change(base: int) -> None:
            mine = self.store.read("stages", base).filter(F.col("id") == stage_id)
            ended = mine.withColumns({"status": F.lit(status), "message": F.lit(message).cast("string"), "finished_at": F.current_timestamp()})
            self.store.change(base, [f"document/{b}" for b in self.store.touched(mine, "document_id")], stages=ended)

        self.store.attempt(change)

    def backfill_franchisors(self) -> None:
        """Missing franchisors taken from the documents' names; rows and their contacts move to the bucket of the name."""

        def change(base: int) -> None:
            names = self.store.read("documents", base).select(F.col("id").alias("document_id"), F.col("franchise_name").alias("_name"))
            missing = self.store.read("locations", base).filter(F.coalesce("franchisor", F.lit("")) == "")
            filled = directory.backfill(missing.join(names, "document_id", "left"), "franchisor", "_name", "franchisor").filter("franchisor <> ''").drop("_name")
            filled = self.store.aside(filled, f"filled-{uuid.uuid4().hex}")
            people = self.store.read("contacts", base).join(filled.select(F.col("id").alias("location_id"), "franchisor"), "location_id")
            moved = lambda df, old: df.withColumn("_deleted", F.lit(False)).unionByName(df.withColumns({"franchisor": F.lit(old), "_deleted": F.lit(True)}))
            brands = {f"brand/{b}" for b in (*self.store.touched(filled, "franchisor"), *self.store.touched(missing, "franchisor"))}
            self.store.change(base, brands, locations=moved(filled, ""), contacts=moved(people, ""))

        self.store.attempt(change)

    def download_headers(self) -> DataFrame:
        return self.store.read("documents").select("id", disposition(F.col("filename")).alias("content_disposition"))


def _columns(ddl: str) -> list[str]:
    """Top-level columns of a schema string."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:k])
            start = k + 1
    return [*out, ddl[start:]]
