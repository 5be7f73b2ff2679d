"""Readers of what a document service has landed as files: listings, exports, manifests, generated files and assets.

Every reader is a Spark scan with a given schema; what is refused shows as an issue, so
one bad file doesn't end a run before all are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The service's types of folders and documents, and the largest export in bytes.
FOLDER, DOCUMENT = "application/vnd.google-apps.folder", "application/vnd.google-apps.document"
EXPORT_BYTES = 10 * 1024 * 1024
LISTING = "id string, name string, mimeType string, parents array<string>, modifiedTime timestamp_ntz, trashed boolean, driveId string"
MANIFEST = "version int, driveId string, rootFolderId string, id string, kind string, name string, parent string, slug string, modified timestamp_ntz, contentHash string, outputHash string, path string"
#: Statuses after which a request is repeated, its first and longest delay, and the longest that a server may ask for, in ms.
RETRIED, FIRST_DELAY, LONGEST_DELAY, LONGEST_ASKED = (429, 500, 502, 503, 504), 250, 10_000, 30_000


def raw_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listed items as landed, one JSON object a line."""
    return spark.read.schema(LISTING).json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """An inventory (id, name, kind, parent, modified) of the items that aren't trashed; an item is below its first parent."""
    return as_inventory(raw_listing(spark, path).where("not trashed"))


def as_inventory(rows: DataFrame) -> DataFrame:
    """(id, name, kind, parent, modified) of listed items."""
    kind = F.when(F.col("mimeType") == FOLDER, "folder").when(F.col("mimeType") == DOCUMENT, "document").otherwise("unsupported")
    return rows.select("id", "name", kind.alias("kind"), F.get("parents", 0).alias("parent"), F.col("modifiedTime").alias("modified"))


def scope_issues(raw: DataFrame, drive: str, root: str) -> DataFrame:
    """(code, item_id): what keeps the root from being a live folder of the drive."""
    found = raw.where(F.col("id") == root).agg(F.count("*").alias("n"), F.max("driveId").alias("drive"), F.max("mimeType").alias("type"), F.bool_or("trashed").alias("trashed"))
    codes = F.when(F.col("n") == 0, F.array(F.lit("scope_root_missing"))).otherwise(
        F.array_compact(F.array(F.when(~F.col("drive").eqNullSafe(drive), "scope_other_drive"), F.when(~F.col("type").eqNullSafe(FOLDER), "scope_not_folder"), F.when(F.col("trashed"), "scope_trashed")))
    )
    return found.select(F.explode(codes).alias("code"), F.lit(root).alias("item_id"))


def exports(spark: SparkSession, path: str, suffix: str = ".md", most: int = EXPORT_BYTES) -> DataFrame:
    """(id, content, issue) of exported files, named by their item; what is larger than ``most`` isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    own = F.substr(name, F.lit(1), F.length(name) - len(suffix)).alias("id")
    read = files.where(F.col("length") <= most).select(own, "content", F.lit(None).cast("string").alias("issue"))  # the filter is pushed down, so larger files aren't opened
    return read.unionByName(files.where(F.col("length") > most).select(own, F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("issue")))


def decoded(exported: DataFrame) -> DataFrame:
    """(id, text, issue): contents as UTF-8; bytes that aren't are an issue."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return exported.select("id", F.when(good, F.col("content").cast("string")).alias("text"), F.coalesce("issue", F.when(~good, "not_utf8")).alias("issue"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of the previous run, one JSON object a line; none where nothing was written yet. What early versions lack is filled.

    Version 1 had no kinds (all were documents) and version 2 no paths.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).json(path)
    made = F.when(F.coalesce("kind", F.lit("document")) == "document", F.concat(F.lit("docs/"), "id", F.lit(".md")))
    return rows.withColumn("kind", F.coalesce("kind", F.lit("document"))).withColumn("path", F.coalesce("path", made)).withColumn("version", F.lit(3))


#: Fields of a manifest's records, by section.
_FIELDS = {
    "documents": {"name": "title", "parent": "parentId", "slug": "slug", "modified": "modifiedTime", "contentHash": "contentHash", "outputHash": "outputHash", "target": None},
    "folders": {"name": "name", "parent": "parentId", "slug": "slug", "modified": None, "contentHash": None, "outputHash": None, "target": None},
    "redirects": {"name": None, "parent": None, "slug": None, "modified": None, "contentHash": None, "outputHash": None, "target": "targetDocumentId"},
}
VERSIONS = (1, 2, 3)


def manifest_documents(raw: DataFrame) -> DataFrame:
    """(owner, section, id, name, parent, slug, modified, contentHash, outputHash, target, version) of whole manifests (owner, json).

    A manifest is one JSON object with its records keyed by id. Of the older versions
    the first has no redirects, and neither has slugs of folders: the next run gives
    them. Texts that aren't JSON, and other versions, have no records (``manifest_issues``).
    """
    parsed = _parsed(raw).where(F.col("version").isin(*VERSIONS))
    out = None
    for section, fields in _FIELDS.items():
        rows = parsed.where("version >= 2") if section == "redirects" else parsed
        exploded = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("v").outer(), f"$.{section}", "variant"))).select("owner", "version", "key", "value")
        value = lambda f: F.lit(None).cast("string") if f is None else F.try_variant_get("value", f"$.{f}", "string")
        own = exploded.select("owner", F.lit(section).alias("section"), F.col("key").alias("id"), *(value(f).alias(name) for name, f in fields.items()), "version")
        if section == "folders":
            own = own.withColumn("slug", F.when(F.col("version") >= 3, F.col("slug")))
        out = own if out is None else out.unionByName(own)
    return out


def _parsed(raw: DataFrame) -> DataFrame:
    rows = raw.select("owner", F.try_parse_json("json").alias("v"))
    return rows.withColumn("version", F.try_variant_get("v", "$.schemaVersion", "int"))


def manifest_issues(raw: DataFrame, drive: str, root: str) -> DataFrame:
    """(owner, code) of manifests (owner, json): not_json, unknown_version, other_scope."""
    field = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    other = ~field("driveId").eqNullSafe(drive) | ~field("rootFolderId").eqNullSafe(root)
    code = F.when(F.col("v").isNull(), "not_json").when(~F.coalesce(F.col("version").isin(*VERSIONS), F.lit(False)), "unknown_version").when(other, "other_scope")
    return _parsed(raw).select("owner", code.alias("code")).where("code is not null")


def manifest_scope_issues(records: DataFrame, drive: str, root: str) -> DataFrame:
    """(code, item_id) of records that belong to another drive or root."""
    other = records.where(~F.col("driveId").eqNullSafe(drive) | ~F.col("rootFolderId").eqNullSafe(root))
    return other.select(F.lit("manifest_scope").alias("code"), F.col("id").alias("item_id"))


def generated(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of generated text files below ``path``, each whole; paths are relative to it."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(_relative(F.input_file_name(), path).alias("path"), F.col("value").alias("content"))


def assets(spark: SparkSession, path: str) -> DataFrame:
    """(path, owner, content, hash) of files below ``path``, at any depth; the owner is the first folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    near = _relative(F.col("path"), path)
    return files.select(near.alias("path"), F.when(F.instr(near, "/") > 0, F.substring_index(near, "/", 1)).alias("owner"), "content", F.sha2("content", 256).alias("hash"))


def _relative(file: Column, path: str) -> Column:
    base = path.rstrip("/").rpartition(":")[2].lstrip("/")
    return F.url_decode(F.replace(F.substring_index(file, f"/{base}/", -1), F.lit("+"), F.lit("%2B")))


def error_class(status: Column) -> Column:
    """What kind of failure an HTTP status is; null for success."""
    return (
        F.when(status == 401, "authentication").when(status.isin(403, 404), "permission").when(status == 429, "rate_limit").when(status.between(500, 599), "server")
        .when(~status.between(200, 299), "invalid_response")
    )


def retry_delay(attempt: Column, asked: Column | None = None) -> Column:
    """Milliseconds before the next attempt (from 0): what the server asks for, within a bound, or twice as long each time."""
    own = F.least(F.lit(float(LONGEST_DELAY)), FIRST_DELAY * F.pow(F.lit(2.0), attempt)).cast("long")
    return own if asked is None else F.when(asked >= 0, F.least(asked, F.lit(LONGEST_ASKED)).cast("long")).otherwise(own)


STRUCTURE = "tabs array<struct<childTabs: array<string>, documentTab: struct<inlineObjects: map<string, string>, positionedObjects: map<string, string>>>>"


def structure(raw: DataFrame) -> DataFrame:
    """(id, tabs, inline, positioned, has_images, has_drawings, issue) of documents' structures (id, json); tabs in tabs are an issue."""
    rows = raw.select("id", F.from_json("json", STRUCTURE).alias("s"))
    objects = lambda kind: F.flatten(F.transform("s.tabs", lambda t: F.coalesce(F.map_values(t["documentTab"][kind]), F.array().cast("array<string>"))))
    rows = rows.select("id", F.size("s.tabs").alias("tabs"), objects("inlineObjects").alias("i"), objects("positionedObjects").alias("p"), F.exists("s.tabs", lambda t: F.size(t["childTabs"]) > 0).alias("nested"), F.col("s.tabs").isNull().alias("none"))
    every = F.concat("i", "p")
    holds = lambda word: F.exists(every, lambda o: o.contains(word))
    issue = F.when(F.col("none"), "no_tabs").when(F.col("nested"), "nested_tabs")
    return rows.select("id", "tabs", F.size("i").alias("inline"), F.size("p").alias("positioned"), holds("imageProperties").alias("has_images"), holds("embeddedDrawingProperties").alias("has_drawings"), issue.alias("issue"))
