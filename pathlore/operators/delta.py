"""Changes of a catalog: removed paths and subtrees out, new records in, postings to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlore.operators import postings as ps
from pathlore.sources.catalog import ancestors


#: Roots that are compared with each path as it is read; more are joined by its ancestors.
FEW_ROOTS = 100


def under_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows whose path is a root (root) or lies under one: a filter for few roots, for more an equality join on
    ancestors, no prefix loop."""
    few = [r.root for r in roots.select("root").distinct().limit(FEW_ROOTS + 1).collect()]
    if len(few) <= FEW_ROOTS:
        under = F.col("path").isin(few)
        for root in few:
            under = under | F.col("path").startswith(root if root.endswith("/") else f"{root}/") if root is not None else under
        return paths.where(under)
    above = F.array_union(ancestors(F.col("path")), F.array("path"))
    hits = paths.select("path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select("path").distinct()
    return paths.join(hits, "path", "left_semi")


def cover(changed: DataFrame) -> DataFrame:
    """The fewest directories that cover changed (path, is_directory): a directory itself, a file's parent, none under
    another."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    dirs = changed.select(F.when(F.col("is_directory"), F.col("path")).otherwise(parent).alias("path")).distinct()
    inside = dirs.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(dirs.select(F.col("path").alias("above")), "above", "left_semi").select("path")
    return dirs.join(inside.distinct(), "path", "left_anti")


def apply_changes(catalog: DataFrame, removed_paths: DataFrame, removed_dirs: DataFrame, upserts: DataFrame) -> DataFrame:
    """catalog without removed paths, without everything at and under removed directories, and with upserts, which win
    over removals and over old records of their id; of several upserts of an id the last (``seq``) does.

    Hit ids are found by equality on exploded ancestors, if any directory is removed, then left out: the catalog itself
    is joined only by id.
    """
    some = not removed_dirs.isEmpty()
    by_dir = catalog.select("id", F.explode(F.array_union(ancestors(F.col("path")), F.array("path"))).alias("at")).join(removed_dirs.select(F.col("path").alias("at")).distinct(), "at", "left_semi")
    by_path = catalog.select("id", "path").join(removed_paths.select("path").distinct(), "path", "left_semi")
    last = upserts.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("rn = 1").drop("rn", "seq")
    gone = by_path.select("id").unionByName(last.select("id"))
    gone = (gone.unionByName(by_dir.select("id")) if some else gone).distinct()
    return catalog.join(gone, "id", "left_anti").unionByName(last.select(*catalog.columns))


def apply_to_postings(old: DataFrame, changed_ids: DataFrame, upserts: DataFrame) -> DataFrame:
    """Postings after a delta: rows of changed ids out, rows of the new records in. Equal to a rebuild."""
    return old.join(changed_ids.select("id").distinct(), "id", "left_anti").select("kind", "key", "id").unionByName(ps.build(upserts))


def stats(before: DataFrame, after: DataFrame, anchors: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = count(anchors, "anchors").crossJoin(count(before, "before_count")).crossJoin(count(after, "after_count"))
    return one.withColumn("delta", F.col("after_count") - F.col("before_count"))
