"""The hierarchy of an inventory: paths, subtrees, selection counters, children and defects.

Inventories have (id, name, kind, parent, modified); kind is folder, document or
unsupported. Paths are found by pointer doubling: in each round every item takes over
the path of the item that it points at, and what that one points at, so the rounds are
the logarithm of the depth, whatever the number of items. A round is one join on id,
staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.sources import shared


def _climbed(state: DataFrame, arrays: list[str]) -> DataFrame:
    """Rows (row, id, at, arrays) that reach an end, where ``at`` is null; the arrays hold all that is passed on the way."""
    state = shared.stage(state, "paths")
    ended = -1
    while True:
        now = state.agg(F.count_if(F.col("at").isNull()), F.count("at")).first()
        if not now[1] or now[0] == ended:  # none is open, or the open ones are in or below cycles
            return state.where("at is null")
        ended = now[0]
        up = state.select(F.col("id").alias("up_id"), F.col("at").alias("up_at"), *(F.col(c).alias(f"up_{c}") for c in arrays))
        open_ = state.where("at is not null").join(up, F.col("at") == F.col("up_id"))
        further = open_.select("row", "id", F.col("up_at").alias("at"), *(F.concat(f"up_{c}", c).alias(c) for c in arrays))
        before, state = state, shared.stage(state.where("at is null").unionByName(further), "paths")
        shared.drop(before)


def _placed(items: DataFrame, end: Column, along: dict[str, Column]) -> DataFrame:
    arrays = {"path": F.col("name"), "ids": F.col("id")} | along
    start = items.select(F.struct(*items.columns).alias("row"), "id", F.when(~end, F.col("parent")).alias("at"), *(F.array(c).alias(k) for k, c in arrays.items()))
    return _climbed(start, list(arrays)).select("row.*", *arrays, (F.size("ids") - 1).alias("depth"))


def paths(items: DataFrame, root: str = "root", **along: Column) -> DataFrame:
    """Descendants of ``root``, itself included, with path (names from it), ids (likewise) and depth.

    ``along``: further arrays of a value of each item on the way. An item that a cycle
    or a missing parent keeps from the root has no row.
    """
    is_root = F.col("id") == root
    return _placed(items.where(is_root | F.col("parent").isNotNull()), is_root, along)


def paths_of_selection(items: DataFrame, **along: Column) -> DataFrame:
    """All items with their paths; one whose parent is not among them starts a new path."""
    known = items.select(F.col("id").alias("parent"), F.lit(True).alias("_known")).distinct()
    marked = items.join(known, "parent", "left")
    return _placed(marked.select(*items.columns, "_known"), F.col("_known").isNull(), along).drop("_known")


def in_order(placed: DataFrame) -> DataFrame:
    """Rows of ``paths`` in the order of a selection: by path, then by id."""
    return placed.orderBy(F.array_join("path", "/"), "id")


def without_subtrees(placed: DataFrame, ignored: list[str]) -> DataFrame:
    """Rows of ``paths`` that are not below, nor among, the ignored folders."""
    return placed.where(~F.arrays_overlap("ids", F.array(*map(F.lit, ignored)).cast("array<string>"))) if ignored else placed


def selection_counts(items: DataFrame, placed: DataFrame, ignored: list[str]) -> DataFrame:
    """One row: all items, descendants of the root, items outside of it, and ignored ones."""
    found = F.arrays_overlap("ids", F.array(*map(F.lit, ignored)).cast("array<string>")) if ignored else F.lit(False)
    counts = placed.agg(F.count("*").alias("descendant_count"), F.count_if(found).alias("ignored_count"))
    every = items.agg(F.count("*").alias("all_item_count"))
    return every.join(counts).withColumn("outside_root_count", F.col("all_item_count") - F.col("descendant_count"))


def children(placed: DataFrame) -> DataFrame:
    """Per folder with children: how many of each kind, and the ids of its folders and documents in order of name and id."""
    ordered = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "id")))), lambda x: x["id"]), ",")
    counts = (F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("folder", "document", "unsupported"))
    return placed.where("parent is not null").groupBy("parent").agg(*counts, ordered("folder").alias("folder_ids"), ordered("document").alias("document_ids"))


def children_in_order(placed: DataFrame) -> DataFrame:
    """(parent, kind, position, id): the folders and documents of each folder as ordered rows, by name and id from 1 on; no folder is one row."""
    rows = placed.where("parent is not null and kind in ('folder', 'document')")
    place = F.row_number().over(Window.partitionBy("parent", "kind").orderBy("name", "id"))
    return rows.select("parent", "kind", place.cast("long").alias("position"), "id")


def multiple_parents(links: DataFrame) -> DataFrame:
    """links: (id, parent), one row per parent of an item."""
    return links.groupBy("id").agg(F.count("*").alias("n_parents")).where("n_parents > 1").select(F.lit("multiple_parents").alias("code"), F.col("id").alias("item_id"), F.lit(None).cast("string").alias("related_id"))


def unresolved_parents(links: DataFrame, items: DataFrame, external: list[str] | None = None) -> DataFrame:
    missing = links.where("parent is not null").join(items.select(F.col("id").alias("parent")), "parent", "left_anti")
    if external:
        missing = missing.where(~F.col("parent").isin(external))
    return missing.select(F.lit("unresolved_parent").alias("code"), F.col("id").alias("item_id"), F.col("parent").alias("related_id"))


def duplicate_ids(items: DataFrame) -> DataFrame:
    """One issue per occurrence after the first."""
    counts = items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return counts.select(F.lit("duplicate_id").alias("code"), F.col("id").alias("item_id"), F.explode(F.expr("sequence(2, n)")).alias("occurrence")).select("code", "item_id", F.col("occurrence").cast("long"))


def cycles(links: DataFrame) -> DataFrame:
    """(item, related): the link that closes each cycle of parents; links have at most one parent per id.

    The link is the one that a walk up from the smallest id comes to last, of all
    items that lead into the cycle. After k rounds of pointer doubling every item
    points 2**k steps up, and those whose way up ends before are gone. A way without a
    cycle is no longer than the items that are left, so the rounds end after the
    logarithm of the depth; what the last items point at lies on cycles. The same
    rounds find the smallest id on the way.
    """
    up = shared.stage(links.where("parent is not null").select("id", F.col("parent").alias("at"), F.col("id").alias("low")), "cycles")
    steps = 1
    while 0 < up.count() >= steps:
        far = up.select(F.col("id").alias("mid"), F.col("at").alias("far"), F.col("low").alias("far_low"))
        before, up = up, shared.stage(up.join(far, F.col("at") == F.col("mid")).select("id", F.col("far").alias("at"), F.least("low", "far_low").alias("low")), "cycles")
        shared.drop(before)
        steps *= 2
    on = up.select(F.col("at").alias("id")).distinct().withColumn("on", F.lit(True))
    # every way into a cycle, up to the first item on it; all items on a cycle share the smallest id of it
    held = links.where("parent is not null").join(up.select("id", "low"), "id").join(on, "id", "left")
    start = held.select(F.struct("id").alias("row"), "id", F.when(F.col("on").isNull(), F.col("parent")).alias("at"), F.array("id").alias("ids"))
    ways = _climbed(start, ["ids"]).select("id", F.get("ids", 0).alias("entry"))
    cycle = held.where("on").select(F.col("id").alias("entry"), F.col("low").alias("cycle"))
    first = ways.join(cycle, "entry").groupBy("cycle").agg(F.min(F.struct("id", "entry")).alias("first"))
    closing = held.where("on").select("id", "parent").join(first.select(F.col("first.entry").alias("parent")), "parent")
    return closing.select(F.lit("cycle").alias("code"), F.col("id").alias("item_id"), F.col("parent").alias("related_id"))


def root_issues(items: DataFrame, root: str = "root") -> DataFrame:
    """What is wrong with the root: not there, or not a folder."""
    found = items.where(F.col("id") == root).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "folder").alias("folders"))
    code = F.when(F.col("n") == 0, "root_not_found").when(F.col("folders") == 0, "root_not_folder")
    return found.select(code.alias("code"), F.lit(root).alias("item_id")).where("code is not null")


def require_sound(*issues: DataFrame, report: int = 50) -> None:
    """Raises one error that lists the issues (code, item_id), up to ``report`` of them and their number."""
    found = issues[0].select("code", "item_id")
    for more in issues[1:]:
        found = found.unionByName(more.select("code", "item_id"))
    n = found.count()
    if n:
        some = found.orderBy("code", "item_id").limit(report).collect()
        raise ValueError(f"{n} issues of the inventory: " + "; ".join(f"{r['code']} {r['item_id']}" for r in some))


def ignored_issues(items: DataFrame, placed: DataFrame, ignored: list[str], root: str = "root") -> DataFrame:
    """Per distinct ignored id that isn't a folder below the root: what is wrong with it."""
    spark = items.sparkSession
    wanted = spark.createDataFrame([(i,) for i in sorted(set(ignored))], "item_id string")
    known = items.select(F.col("id").alias("item_id"), "kind").dropDuplicates(["item_id"])
    inside = placed.select(F.col("id").alias("item_id"), F.lit(True).alias("inside"))
    joined = F.broadcast(wanted).join(known, "item_id", "left").join(inside, "item_id", "left")
    code = F.when(F.col("item_id") == root, "ignored_root").when(F.col("kind").isNull(), "ignored_not_found").when(F.col("kind") != "folder", "ignored_not_folder").when(F.col("inside").isNull(), "ignored_outside_root")
    return joined.select(code.alias("code"), "item_id").where("code is not null")


def subtree_sizes(placed: DataFrame, kind: str = "document") -> DataFrame:
    """(id, size): items of a kind in each item's subtree, itself included; items without any have no row."""
    return placed.where(F.col("kind") == kind).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("size"))


def running_in_parent(order: list, value: str):
    """Sum of ``value`` over earlier siblings."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("parent").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
