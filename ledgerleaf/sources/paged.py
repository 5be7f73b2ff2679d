"""A Spark data source of landed listings: the pages that a document service gave out, each with the token of the next.

    spark.dataSource.register(paged.PagedListing)
    spark.read.format("landed_pages").load(folder)                           # listed items
    spark.read.format("landed_pages").option("what", "pages").load(folder)   # (token, next, incomplete, items)

Every file is a page, a JSON object with pageToken (none on the first), nextPageToken,
incompleteSearch and files. A partition is a few files, so pages are read in parallel;
the planner only lists their names, which the service's own limit bounds. With the option
``pushdown`` a filter on ``trashed`` is answered in the reader, where the session allows
it (``spark.sql.python.filterPushdown.enabled``); ``listing`` asks for it then. Of a
narrower schema only those fields are taken. Files are opened by Arrow's file
systems, so paths can be local or in an object store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, InputPartition, IsNotNull, Not
from pyspark.sql.types import StructType

from ledgerleaf.sources import landed

if TYPE_CHECKING:
    from pyarrow import fs

#: Fixed value: a listing has no more pages than that.
MOST_PAGES = 10_000
#: Files of a partition.
FILES = 16
PAGES = "token string, next string, incomplete boolean, items long"
ITEMS = "id string, name string, mimeType string, parents array<string>, modifiedTime string, trashed boolean, driveId string"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs  # here, as it starts threads and Spark's daemon forks

    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"{scheme}://{rest}" if rest.startswith("/") and not rest.startswith("//") else path)


class _Files(InputPartition):
    def __init__(self, files: Sequence[str]) -> None:
        super().__init__(list(files))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.pages, self.fields = options["path"], options.get("what", "items") == "pages", schema.fieldNames()
        self.most, self.trashed = int(options.get("most", MOST_PAGES)), None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = file_system(self.path)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".json"))
        if len(files) > self.most:
            raise ValueError(f"the listing has more than {self.most} pages")
        return [_Files(files[i : i + FILES]) for i in range(0, len(files), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for file in partition.value:
            with system.open_input_stream(file) as stream:
                page = json.loads(stream.read())
            if self.pages:
                row = {"token": page.get("pageToken"), "next": page.get("nextPageToken"), "incomplete": bool(page.get("incompleteSearch")), "items": len(page.get("files", ()))}
                yield tuple(row[f] for f in self.fields)
                continue
            for item in page.get("files", ()):
                if self.trashed is None or bool(item.get("trashed", False)) == self.trashed:
                    yield tuple(bool(item.get(f, False)) if f == "trashed" else item.get(f) for f in self.fields)


class _FilteringReader(_Reader):
    """Answers ``trashed = true`` or ``false`` itself; Spark refuses such a reader where its setting is off."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            wanted = _trashed(f)
            if wanted is not None:
                self.trashed = wanted
            elif f != IsNotNull(("trashed",)):  # it never is
                yield f


def _trashed(f: Filter) -> bool | None:
    """What a filter asks of ``trashed``; null for others."""
    if isinstance(f, Not):
        inner = _trashed(f.child)
        return None if inner is None else not inner
    if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == ("trashed",) and isinstance(f.value, bool):
        return f.value
    return None


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGES if self.options.get("what", "items") == "pages" else ITEMS

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_FilteringReader if self.options.get("pushdown") == "true" else _Reader)(dict(self.options), schema)


def _read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedListing)
    return spark.read.format("landed_pages").options(**options).load(path)


def chain_issues(spark: SparkSession, path: str, most: int = MOST_PAGES) -> DataFrame:
    """(code, token): what keeps the pages from being one whole listing.

    incomplete_search, repeated_token (two pages lead to one), missing_page (a token
    that no page has), first_page (none, or several, without a token).
    """
    pages = _read(spark, path, what="pages", most=str(most))
    incomplete = pages.where("incomplete").select(F.lit("incomplete_search").alias("code"), "token")
    repeated = pages.where("next is not null").groupBy(F.col("next").alias("token")).count().where("count > 1").select(F.lit("repeated_token").alias("code"), "token")
    missing = pages.where("next is not null").select(F.col("next").alias("token")).distinct().join(pages.select("token"), "token", "left_anti").select(F.lit("missing_page").alias("code"), "token")
    first = pages.agg(F.count_if(F.col("token").isNull()).alias("n")).where("n <> 1").select(F.lit("first_page").alias("code"), F.lit(None).cast("string").alias("token"))
    return incomplete.unionByName(repeated).unionByName(missing).unionByName(first)


def listing(spark: SparkSession, path: str, most: int = MOST_PAGES) -> DataFrame:
    """An inventory (id, name, kind, parent, modified) of a whole listing's items that aren't trashed; raises if pages are missing or repeat."""
    issues = chain_issues(spark, path, most).limit(20).collect()
    if issues:
        raise ValueError("the listing isn't whole: " + ", ".join(f"{r.code} {r.token or ''}".strip() for r in issues))
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    rows = _read(spark, path, most=str(most), pushdown=pushdown).where("trashed = false")
    return landed.as_inventory(rows.withColumn("modifiedTime", F.col("modifiedTime").cast("timestamp_ntz")))
