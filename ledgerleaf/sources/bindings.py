"""Inventories, manifests, redirects, bodies, pages and links read from the driver's tables.

The tables hold no drive listing, so these views give theirs: regions and nations are
folders, customers and suppliers documents, parts unsupported items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(item, name, kind: str, parent, modified=None):
    return [item.alias("id"), name.alias("name"), F.lit(kind).alias("kind"), parent.alias("parent"), (F.lit(None).cast("timestamp_ntz") if modified is None else modified).alias("modified")]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind, parent, modified)."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    root = spark.range(1).select(*_row(F.lit("root"), F.lit("Corpus"), "folder", F.lit(None).cast("string")))
    regions = t("region").select(*_row(key("r", "r_regionkey"), F.concat(F.lpad(F.col("r_regionkey").cast("string"), 2, "0"), F.lit(" - "), "r_name"), "folder", F.lit("root")))
    nations = t("nation").select(*_row(key("n", "n_nationkey"), F.col("n_name"), "folder", key("r", "n_regionkey")))
    latest = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("modified"))
    customers = t("customer").join(latest, "c_custkey", "left").select(*_row(key("c", "c_custkey"), F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 7).cast("string")), "document", key("n", "c_nationkey"), F.col("modified")))
    suppliers = t("supplier").select(*_row(key("s", "s_suppkey"), F.lit("Overview"), "document", key("n", "s_nationkey")))
    parts = t("part").select(*_row(key("p", "p_partkey"), F.col("p_name"), "unsupported", F.concat(F.lit("r"), (F.col("p_partkey") % 5).cast("string"))))
    return root.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(suppliers).unionByName(parts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("kind = 'document'")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a previous run: some documents missing, some older, some elsewhere, and some that are gone since."""
    key = F.expr("try_cast(substring(id, 2) as bigint)")
    rows = documents(spark, sf_dir).withColumn("key", key).where("id like 's%' or key % 10 <> 0")
    is_customer = F.col("id").startswith("c")
    modified = F.when(is_customer & (F.col("key") % 10 == 1), F.col("modified") - F.expr("interval 1 day")).otherwise(F.col("modified"))
    parent = F.when(is_customer & (F.col("key") % 50 == 2), F.lit("n0")).otherwise(F.col("parent"))
    kept = rows.select("id", "name", "kind", parent.alias("parent"), modified.alias("modified"))
    ghosts = table(spark, sf_dir, "customer").where("c_custkey % 97 = 0").select(*_row(F.concat(F.lit("x"), F.col("c_custkey").cast("string")), F.col("c_name"), "document", F.lit("n1")))
    return kept.unionByName(ghosts)


def parent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent) with deterministic defects: second parents, missing parents, and cycles of two."""
    own = items(spark, sf_dir).select("id", "parent")
    customers = table(spark, sf_dir, "customer")
    second = customers.where("c_custkey % 40 = 3").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("n2").alias("parent"))
    lost = customers.where("c_custkey % 60 = 7").select(F.concat(F.lit("l"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("gone"), F.col("c_custkey").cast("string")).alias("parent"))
    loops = customers.where("c_custkey % 80 = 9").select(F.explode(F.array(F.struct(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("parent")), F.struct(F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("parent")))).alias("x")).select("x.*")
    return own.unionByName(second).unionByName(lost).unionByName(loops)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, body, lang): documents with their first line as title."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), F.col("text").alias("body"), "lang")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, position, href): links of pages in order."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("position", "href"))
    return found
