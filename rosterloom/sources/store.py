"""Tables in buckets, changed by small files and read as snapshots; changes of different brands commit at once."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grams
from ..schema import EMPTY_TABLES, SEARCHED
from ..session import SHUFFLED

T = TypeVar("T")

#: Buckets of each table in a new store.
BUCKETS = 16
#: How often a change is made anew after another one came first, and how often a number is tried for.
ATTEMPTS = 5
CLAIMS = 200
#: Seconds after which a claim without its pointer counts as left behind.
CLAIM_SECONDS = 600
#: Files of changes after which a bucket is rewritten.
COMPACT_AT = 8
#: The beginning of the posting by which a location is found by its id; no run of letters begins so.
OWN = "\x04"
#: What every change meets.
ALL = "*"

#: The column whose hash is a row's bucket; contacts go by the franchisor of their location.
_PLACE = {"documents": "id", "stages": "document_id", "locations": "franchisor", "contacts": "franchisor", "postings": "gram", "tallies": "document_id"}


class ConcurrentChange(RuntimeError):
    """Another change touched what this one was made from after it was read."""


class SnapshotStore:
    """Directory tables below a root that Spark can write; readers see whole changes only.

    A change writes only the rows that it adds, replaces or deletes, each into its bucket, and
    then adds one numbered manifest, which lists for each table and bucket the folders of its
    changes in order.  Readers take the last row of each id in buckets with several folders;
    ``compact`` makes one of them again.  A change of locations also adds their postings of
    three letters (``postings``, see ``grams``), by which searches find their buckets and ids,
    and what it changes in the counts by document and status (``tallies``).

    A change names what it was made from and what it touches as *scopes*, such as a brand's
    bucket.  If other changes came first, it is added after them as it is, provided that none
    touched one of its scopes; else it fails with ``ConcurrentChange``, and ``attempt`` makes it
    anew.  So two brands commit at once, each writing its own buckets.

    Numbers are claimed by files that a file system creates once only, as HDFS does.  A claim
    whose driver was lost is taken over after ``CLAIM_SECONDS``.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        path = self._path(f"{self.root}/pointers")
        self._files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(path)
        last = self.version()
        self.buckets = self.manifest(last)["buckets"] if last else buckets

    # ------------------------------------------------------------------ manifests

    def version(self) -> int:
        """The number of the last change, 0 before any."""
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(f"{self.root}/pointers"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        """The scopes that a change touched, and the folders of each table's buckets after it, in order."""
        if not version:
            return {"buckets": self.buckets, "scopes": [], "tables": {}}
        return json.loads(self._text(self._path(f"{self.root}/pointers/{version}")))

    def _text(self, path) -> str:
        stream = self._files.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path, text: str) -> None:
        out = self._files.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    # ------------------------------------------------------------------ reading

    def bucket(self, column: Column) -> Column:
        """The bucket of a document id or brand; letters of either case are one brand."""
        return F.pmod(F.xxhash64(F.lower(F.coalesce(column, F.lit("")))), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame, column: str) -> list[int]:
        """The buckets of a column's values: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in df.select(self.bucket(F.col(column)).alias("b")).distinct().collect())

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of a change, the last one by default; of some of its buckets only, if they are given.

        Joins with it shuffle and never broadcast (``SHUFFLED``).
        """
        entries = self.manifest(self.version() if version is None else version)["tables"].get(name, {})
        if buckets is not None:
            entries = {b: entries[b] for b in map(str, buckets) if b in entries}
        return self._rows(name, entries).hint(SHUFFLED)

    def postings(self, term: str, version: int) -> DataFrame | None:
        """id and held_in (a bucket) of the locations that ``%term%`` can match; None if that can be all of them."""
        entries = self.manifest(version)["tables"].get("postings", {})
        needed, _ = grams.term_grams(term)
        if needed:
            asked = self.touched(self.spark.createDataFrame([(g,) for g in needed], "gram string"), "gram")
            entries = {b: entries[b] for b in map(str, asked) if b in entries}
        posted = self._rows_of("postings", entries)
        return grams.candidates(posted.withColumn("at", F.struct("id", "held_in")), "at", term)

    def _rows_of(self, name: str, entries: dict[str, list[list[str]]], *more: str) -> DataFrame:
        """All rows of folders as they were written."""
        places, schema = [f"{self.root}/{place}" for x in entries.values() for place, *_ in x], ", ".join([EMPTY_TABLES[name], *more])
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _rows(self, name: str, entries: dict[str, list[list[str]]]) -> DataFrame:
        """The last row of each id, unless it is deleted."""
        schema = EMPTY_TABLES[name]
        whole = [x[0][0] for x in entries.values() if len(x) == 1 and x[0][1] == "rows"]
        layered = [x for x in entries.values() if len(x) > 1 or x[0][1] != "rows"]
        out = None
        if whole:
            out = self.spark.read.schema(schema).parquet(*(f"{self.root}/{place}" for place in whole))
        if layered:
            turns = {place.split("/")[0]: turn for x in layered for place, _, turn in x}
            turn = F.element_at(F.create_map(*(F.lit(x) for pair in turns.items() for x in pair)), F.regexp_extract("_metadata.file_path", "(change-[0-9a-f]{32})/", 1))
            rows = self.spark.read.schema(f"{schema}, _deleted boolean").parquet(*(f"{self.root}/{place}" for x in layered for place, *_ in x)).withColumn("_turn", turn)
            # by bucket, as a row that moves is deleted in one and added in another
            rows = rows.withColumn("_bucket", F.regexp_extract("_metadata.file_path", "/_bucket=([0-9]+)/", 1))
            last = rows.groupBy("_bucket", "id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("_turn", "_bucket"))), "_turn").alias("_row"))
            last = last.filter(~F.coalesce("_row._deleted", F.lit(False))).select("_row.*").drop("_deleted")
            out = last if out is None else out.unionByName(last)
        return self.spark.createDataFrame([], schema) if out is None else out

    # ------------------------------------------------------------------ tables aside

    def aside(self, df: DataFrame, place: str) -> DataFrame:
        """A table written below the root and read again: intermediate rows that outlive lost executors."""
        df.write.parquet(f"{self.root}/{place}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{place}").hint(SHUFFLED)

    def drop(self, place: str) -> None:
        """Removes what ``aside`` wrote below a place."""
        self._files.delete(self._path(f"{self.root}/{place}"), True)

    # ------------------------------------------------------------------ changes

    def change(self, base: int, scopes: Iterable[str], **tables: DataFrame) -> int:
        """Adds rows to tables, replaces those with the same id, and deletes those marked by ``_deleted``.

        ``base`` is the version that the change was made from.  Contacts have the
        franchisor of their location as an additional column.
        """
        return self._commit(base, scopes, tables, replace=False)

    def commit(self, base: int | None = None, **tables: DataFrame) -> int:
        """Replaces the named tables as a whole, together."""
        if "contacts" in tables and "franchisor" not in tables["contacts"].columns:
            brands = tables.get("locations", self.read("locations", base)).select(F.col("id").alias("location_id"), "franchisor")
            tables["contacts"] = tables["contacts"].join(brands, "location_id", "left")
        return self._commit(base, [ALL], tables, replace=True)

    def _commit(self, base: int | None, scopes: Iterable[str], tables: dict[str, DataFrame], replace: bool) -> int:
        base = self.version() if base is None else base
        change = f"change-{uuid.uuid4().hex}"
        written = {name: self._write(name, df, change) for name, df in tables.items()}
        if "locations" in written:
            rows = self._rows_of("locations", {b: [[place, kind, 0]] for b, (place, kind) in written["locations"].items()}, "_deleted boolean")
            written["postings"] = self._write("postings", self._posted(rows), change)
            before = None if replace else self.read("locations", base, map(int, written["locations"]))
            written["tallies"] = self._write("tallies", self._tallied(rows, before, change), change)

        def added(manifest: dict, number: int) -> dict:
            for name, places in written.items():
                held = {} if replace else manifest["tables"].get(name, {})
                for bucket, (place, kind) in places.items():
                    held.setdefault(bucket, []).append([place, kind, number])
                manifest["tables"][name] = held
            return manifest

        return self._publish(base, sorted(set(scopes)), change, added)

    def _posted(self, locations: DataFrame) -> DataFrame:
        keyed = locations.filter(~F.coalesce("_deleted", F.lit(False))).select(F.struct("id", self.bucket(F.col("franchisor")).alias("held_in")).alias("at"), *SEARCHED)
        own = keyed.select("at.*", F.concat(F.lit(OWN), "at.id").alias("gram"))
        return grams.postings(keyed, "at", list(SEARCHED)).select("at.*", "gram").unionByName(own)

    def holders(self, location_id: str, version: int) -> list[int]:
        """The buckets that a location is in, or was: one, but for rows that have moved."""
        key = OWN + location_id
        entries = self.manifest(version)["tables"].get("postings", {})
        asked = self.touched(self.spark.createDataFrame([(key,)], "gram string"), "gram")
        found = self._rows_of("postings", {b: entries[b] for b in map(str, asked) if b in entries}).filter(F.col("gram") == key)
        return sorted(r[0] for r in found.select("held_in").distinct().collect())

    def _tallied(self, rows: DataFrame, before: DataFrame | None, change: str) -> DataFrame:
        """By how much written rows change the counts: what they are now, less what those with their ids were."""
        by = ["document_id", "status", "review_status"]
        counted = rows.filter(~F.coalesce("_deleted", F.lit(False))).select(*by, F.lit(1).alias("one"))
        if before is not None:
            counted = counted.unionByName(before.join(rows.select("id").distinct(), "id", "left_semi").select(*by, F.lit(-1).alias("one")))
        sums = counted.groupBy(*by).agg(F.sum("one").cast("long").alias("n")).filter("n <> 0")
        return sums.withColumn("id", F.sha2(F.to_json(F.struct(F.lit(change).alias("change"), *by)), 256))

    def tallies(self, version: int | None = None) -> DataFrame:
        """document_id, status, review_status and n, the number of locations, from the sums that changes keep up."""
        entries = self.manifest(self.version() if version is None else version)["tables"].get("tallies", {})
        return self._rows_of("tallies", entries).groupBy("document_id", "status", "review_status").agg(F.sum("n").alias("n")).filter("n <> 0").hint(SHUFFLED)

    def _write(self, name: str, df: DataFrame, change: str) -> dict[str, tuple[str, str]]:
        """Writes rows into their buckets; a bucket's folder has rows only, or also deletions."""
        columns = [f.name for f in self._rows(name, {}).schema]
        deletes = "_deleted" in df.columns
        rows = df.withColumn("_bucket", self.bucket(F.col(_PLACE[name]))).select(*columns, *(["_deleted"] if deletes else []), "_bucket")
        path = f"{self.root}/{change}/{name}"
        rows.hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", "gram" if name == "postings" else "id").write.partitionBy("_bucket").parquet(path)
        kind = "changes" if deletes else "rows"
        folders = (f.getPath().getName() for f in self._files.listStatus(self._path(path)))
        return {x.removeprefix("_bucket="): (f"{change}/{name}/{x}", kind) for x in folders if x.startswith("_bucket=")}

    def _publish(self, base: int, scopes: list[str], change: str, added: Callable[[dict, int], dict]) -> int:
        """Adds a manifest after the last one, if nothing since ``base`` touched one of the scopes."""
        seen = base
        for _ in range(CLAIMS):
            last = self.version()
            while seen < last:
                seen += 1
                theirs = self.manifest(seen)["scopes"]
                if theirs and scopes and (ALL in theirs or ALL in scopes or not set(theirs).isdisjoint(scopes)):
                    raise ConcurrentChange(f"version {seen} of {self.root} has changed what version {base} was read for")
            claim, pointer = (self._path(f"{self.root}/pointers/{x}") for x in (f"claim-{last + 1}", f"new-{change}"))
            if not self._claim(claim, change, last + 1):
                continue
            try:
                manifest = added(self.manifest(last), last + 1) | {"scopes": scopes}
                self._put(pointer, json.dumps(manifest))
                if self._text(claim) == change and self._files.rename(pointer, self._path(f"{self.root}/pointers/{last + 1}")):
                    return last + 1
            except Exception:
                self._files.delete(claim, False)
                raise
            self._files.delete(pointer, False)  # the claim was taken over
        raise ConcurrentChange(f"no number could be claimed in {self.root}")

    def _claim(self, claim, change: str, number: int) -> bool:
        """Whether this change has the number now; waits a moment if not, and removes claims that were left behind."""
        try:
            self._put(claim, change)
            return True
        except Exception:  # the file system says in its own way that the file is there
            if not self._files.exists(claim):
                raise
        if not self._files.exists(self._path(f"{self.root}/pointers/{number}")):
            if time.time() * 1000 - self._files.getFileStatus(claim).getModificationTime() > CLAIM_SECONDS * 1000:
                self._files.delete(claim, False)
            else:
                time.sleep(random.uniform(0.05, 0.2))
        return False

    def attempt(self, change: Callable[[int], T]) -> T:
        """Makes a change from the version it is given, anew if another one touched the same first."""
        for turn in range(ATTEMPTS):
            try:
                return change(self.version())
            except ConcurrentChange:
                if turn + 1 == ATTEMPTS:
                    raise
                time.sleep(random.uniform(0, 2**turn))
        raise AssertionError("unreachable")

    # ------------------------------------------------------------------ upkeep

    def compact(self, least: int = COMPACT_AT) -> int:
        """Rewrites buckets of at least so many folders as one folder each; changes that come meanwhile stay after it."""
        base = self.version()
        tables = {name: {b: x for b, x in held.items() if len(x) >= least} for name, held in self.manifest(base)["tables"].items()}
        tables = {name: held for name, held in tables.items() if held}
        if not tables:
            return base
        change, written = f"change-{uuid.uuid4().hex}", {}
        for name, held in tables.items():
            rows = self._rows(name, held)
            if name == "postings":  # each once, and none of locations that are gone
                posted = self._rows_of(name, held).distinct()
                now = self.read("locations", base)
                rows = posted.join(now.select("id", self.bucket(F.col("franchisor")).alias("held_in")), ["id", "held_in"], "left_semi")
            if name == "tallies":  # one row for each sum
                sums = self._rows_of(name, held).groupBy("document_id", "status", "review_status").agg(F.sum("n").alias("n")).filter("n <> 0")
                rows = sums.withColumn("id", F.sha2(F.to_json(F.struct(F.lit(change).alias("change"), "document_id", "status", "review_status")), 256))
            if name == "contacts":
                brands = self.read("locations", base, map(int, held)).select(F.col("id").alias("location_id"), "franchisor")
                rows = rows.join(brands, "location_id", "left")
            written[name] = self._write(name, rows, change)

        def replaced(manifest: dict, number: int) -> dict:
            for name, held in tables.items():
                now = manifest["tables"][name]
                for bucket, old in held.items():
                    if now.get(bucket, [])[: len(old)] != old:
                        raise ConcurrentChange(f"bucket {bucket} of {name} has been rewritten")
                    new = [[*written[name][bucket], 0]] if bucket in written[name] else []  # before all that comes after
                    now[bucket] = new + now[bucket][len(old) :]
                    if not now[bucket]:
                        del now[bucket]
            return manifest

        return self._publish(base, [], change, replaced)

    def vacuum(self, keep: int = 2) -> None:
        """Removes change folders that none of the last ``keep`` versions names; run while nothing reads older ones and no change is under way."""
        last = self.version()
        held = {place.split("/")[0] for v in range(max(1, last - keep + 1), last + 1) for table in self.manifest(v)["tables"].values() for x in table.values() for place, *_ in x}
        for f in self._files.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name.startswith("change-") and name not in held:
                self._files.delete(f.getPath(), True)
