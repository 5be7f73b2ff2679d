"""Editorial order of siblings, issues with it, the navigation tree and its reading order.

Every window is partitioned by folder. The reading order of the whole tree needs no
sort of it: a document's number is the documents before its ancestors among their
siblings, added up along its path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import labels
from ledgerleaf.operators import hierarchy

LANDING = ("Overview", "README", "About")


def with_keys(rows: DataFrame, landing: tuple[str, ...] = LANDING) -> DataFrame:
    """Adds label, tier (0 landing document, 1 numbered, 2 other), tier_rank and sort_key."""
    rows = rows.withColumn("order_number", labels.order_number(F.col("name"))).withColumn("label", labels.shown(F.col("name")))
    place = F.array_position(F.array(*(F.lit(t.lower()) for t in landing)), F.lower("label"))
    is_landing = (F.col("kind") == "document") & F.col("order_number").isNull() & (place > 0)
    tier = F.when(F.col("order_number").isNotNull(), 1).when(is_landing, 0).otherwise(2)
    rank = F.when(F.col("order_number").isNotNull(), F.col("order_number")).when(is_landing, place).otherwise(0)
    return rows.withColumn("tier", tier).withColumn("tier_rank", rank.cast("int")).withColumn("sort_key", labels.natural_key(F.col("label")))


def order_columns() -> list:
    return ["tier", "tier_rank", F.collate("sort_key", "UNICODE_CI_AI"), "id"]


def siblings(placed: DataFrame, landing: tuple[str, ...] = LANDING) -> DataFrame:
    """Folders and documents with sibling_rank, from 1 in their folder."""
    rows = with_keys(placed.where("kind in ('folder', 'document') and parent is not null"), landing)
    return rows.withColumn("sibling_rank", F.row_number().over(Window.partitionBy("parent").orderBy(*order_columns())))


def issues(ranked: DataFrame) -> DataFrame:
    """(code, item_id, related_id): repeated numbers, further landing documents, and unknown prefixes in numbered folders."""
    numbered = Window.partitionBy("parent", "tier", "tier_rank").orderBy("sibling_rank")
    landing = Window.partitionBy("parent", "tier").orderBy("sibling_rank")
    repeated = ranked.where("tier = 1").withColumn("first", F.first("id").over(numbered)).where("id <> first").select(F.lit("duplicate_navigation_order").alias("code"), F.col("id").alias("item_id"), F.col("first").alias("related_id"))
    further = ranked.where("tier = 0").withColumn("first", F.first("id").over(landing)).where("id <> first").select(F.lit("multiple_landing_documents").alias("code"), F.col("id").alias("item_id"), F.col("first").alias("related_id"))
    numbering = ranked.withColumn("numbering", F.min("tier").over(Window.partitionBy("parent")) < 2)
    unknown = numbering.where(F.col("numbering") & labels.unrecognized_prefix(F.col("name"))).select(F.lit("unrecognized_order_prefix").alias("code"), F.col("id").alias("item_id"), F.lit(None).cast("string").alias("related_id"))
    return repeated.unionByName(further).unionByName(unknown)


def navigation(placed: DataFrame, ranked: DataFrame) -> DataFrame:
    """Nodes of the navigation: folders with a document somewhere below, and documents; adds size (documents below)."""
    return ranked.join(hierarchy.subtree_sizes(placed), "id")


def reading_order(placed: DataFrame, ranked: DataFrame) -> DataFrame:
    """(id, place): documents numbered from 1 in the order of the navigation."""
    nodes = navigation(placed, ranked).withColumn("before", hierarchy.running_in_parent(["sibling_rank"], "size")).select(F.col("id").alias("node"), "before")
    along = placed.where("kind = 'document'").select("id", F.explode(F.expr("slice(ids, 2, size(ids))")).alias("node"))
    return along.join(nodes, "node").groupBy("id").agg((F.sum("before") + 1).alias("place"))


def neighbours(order: DataFrame) -> DataFrame:
    """(id, previous_id, next_id) by place."""
    near = lambda by, name: order.select((F.col("place") + by).alias("place"), F.col("id").alias(name))
    return order.join(near(1, "previous_id"), "place", "left").join(near(-1, "next_id"), "place", "left").select("id", "previous_id", "next_id")


def navigation_tree(placed: DataFrame, ranked: DataFrame, root: str = "root") -> DataFrame:
    """(id, group, parent, label, kind, rank): the navigation, with the root's own documents in a leading group General.

    Groups are numbered in order: General 0, then the root's folders by their rank. A
    folder without documents below is no node.
    """
    nodes = navigation(placed, ranked)
    own = (F.col("parent") == root) & (F.col("kind") == "document")
    top = F.when(own, F.lit("General")).when(F.col("parent") == root, F.col("id"))
    inside = placed.select("id", F.get("ids", 1).alias("top"))
    rows = nodes.join(inside, "id").withColumn("group", F.coalesce(top, "top"))
    ranks = nodes.where((F.col("parent") == root) & (F.col("kind") == "folder")).select(F.col("id").alias("group"), F.col("sibling_rank").alias("group_rank"))
    return rows.join(ranks, "group", "left").select("id", "group", "parent", "label", "kind", F.coalesce("group_rank", F.lit(0)).cast("long").alias("group_rank"), F.col("sibling_rank").cast("long").alias("rank"))


def section_pages(ranked: DataFrame, folders: DataFrame, described: DataFrame) -> DataFrame:
    """(id, position, line): lines of each folder's page - its children in order, documents with their description; a sentence for none.

    folders: (id, slug); described: (id, slug, description) of folders and documents.
    """
    child = ranked.select(F.col("parent").alias("section"), "id", "label", "sibling_rank").join(described, "id")
    text_ = F.concat(F.lit("- ["), "label", F.lit("](/"), "slug", F.lit("/)"), F.coalesce(F.concat(F.lit(": "), "description"), F.lit("")))
    rows = folders.select(F.col("id").alias("section")).join(child.select("section", "sibling_rank", text_.alias("line")), "section", "left")
    return rows.select(F.col("section").alias("id"), F.coalesce("sibling_rank", F.lit(0)).cast("long").alias("position"), F.coalesce("line", F.lit("This section has no documents yet.")).alias("line"))


def require_records(nodes: DataFrame, records: DataFrame, report: int = 20) -> DataFrame:
    """``nodes`` joined with their records by id; raises if one has none."""
    missing = nodes.join(records.select("id"), "id", "left_anti").select("id").orderBy("id").limit(report).collect()
    if missing:
        raise ValueError("navigation without records: " + ", ".join(r["id"] for r in missing))
    return nodes.join(records, "id")


def issues_in_order(found: DataFrame) -> DataFrame:
    return found.orderBy("code", "item_id")
