"""Digests of folders, level by level, that are brought up to date branch by branch.

A folder's digest is that of its children, a file's is given.  The children of a folder are dealt into bins by a hash of their name, each bin
has the digest of its children in order, and the folder the digest of its bins, so a folder of any size is the work of many tasks.

A tree is a table of nodes (parent, name, kind, digest) in the shared folder, laid out by a hash of the parent.  After changes only the folders on
the paths of changed files are hashed again, and only the parts of the table that hold those folders are read.

Defined cases: a path is split at slashes, empty parts do not count; of a path that stands twice the greater digest counts; an empty listing has the root alone,
with the digest of nothing; folders without files are no nodes, as in the listing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.sources.scratch import kept, scratch_folder

BIN_HEX, PARTS = 2, 64
NODE = "parent string, name string, kind string, digest string, depth int"


def files_of(listing: DataFrame, rel: str = "rel", digest: str = "sha256") -> DataFrame:
    """The nodes of listed files; a null digest says that the file is gone."""
    parts = F.filter(F.split(rel, "/"), lambda p: p != "")
    rows = listing.select(parts.alias("p"), F.col(digest).alias("digest")).filter(F.size("p") > 0)
    named = rows.select(F.array_join(F.slice("p", 1, F.size("p") - 1), "/").alias("parent"), F.element_at("p", -1).alias("name"), F.lit("file").alias("kind"), "digest", F.size("p").alias("depth"))
    return named.groupBy("parent", "name", "kind", "depth").agg(F.max("digest").alias("digest")).select("parent", "name", "kind", "digest", "depth")


def folders_of(children: DataFrame, depth: int) -> DataFrame:
    """The nodes, one level up, of the folders that hold children of one depth."""
    line = lambda *c: F.concat_ws("\0", *c)
    joined = lambda lines: F.sha2(F.array_join(F.sort_array(F.collect_list(lines)), "\n"), 256)
    bins = children.groupBy("parent", F.substring(F.sha2("name", 256), 1, BIN_HEX).alias("bin")).agg(joined(line("name", "kind", "digest")).alias("d"))
    whole = bins.groupBy("parent").agg(joined(line("bin", "d")).alias("digest"))
    above = F.when(F.contains("parent", F.lit("/")), F.regexp_extract("parent", "^(.*)/[^/]*$", 1)).otherwise("")
    named = whole.filter("parent <> ''").select(above.alias("of"), F.regexp_extract("parent", "([^/]*)$", 1).alias("name"), "digest")
    root = whole.filter("parent = ''").select(F.lit(None).cast("string").alias("of"), F.lit("").alias("name"), "digest")
    return named.unionByName(root).select(F.col("of").alias("parent"), "name", F.lit("folder").alias("kind"), "digest", F.lit(depth - 1).alias("depth"))


def part(parent: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(parent, F.lit("\0"))), F.lit(PARTS)).cast("int")


def stored(nodes: DataFrame, label: str) -> str:
    """Writes nodes by the part of their parent; the path."""
    spark = nodes.sparkSession
    path = f"{scratch_folder(spark)}/{label}"
    nodes.withColumn("part", part(F.col("parent"))).repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(path)
    return path


def folded(spark: SparkSession, files: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """files with the nodes of all folders above them.  others: nodes that stand beside them and do not change, for folders that hold both."""
    levels = [kept(files.filter("digest IS NOT NULL"), "tree-level")]
    deepest = files.agg(F.max("depth")).first()[0] or 0
    at = levels[0].filter(F.col("depth") == deepest)
    for depth in range(deepest, 0, -1):
        beside = at if others is None else at.unionByName(others.filter(F.col("depth") == depth).join(at.select("parent", "name", "kind"), ["parent", "name", "kind"], "left_anti").select(at.columns))
        above = kept(folders_of(beside, depth), "tree-level")
        levels.append(above)
        at = above.unionByName(levels[0].filter(F.col("depth") == depth - 1))
    return reduce(DataFrame.unionByName, levels)


def brought_up_to_date(spark: SparkSession, path: str, changed: DataFrame) -> tuple[DataFrame, list[int]]:
    """The nodes that are new or different after changed files (files_of() rows, digest null for those gone), and the parts of the stored tree that were read."""
    touched = changed.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("parent", "/"))), lambda n: F.array_join(F.slice(F.split("parent", "/"), 1, n), "/"))).alias("folder")).distinct()
    touched = kept(touched, "tree-touched")
    parts = sorted(p for (p,) in touched.select(part(F.col("folder"))).distinct().collect())  # as many as there are parts at most
    old = spark.read.schema(f"{NODE}, part int").parquet(path).filter(F.col("part").isin(*parts)) if parts else spark.createDataFrame([], f"{NODE}, part int")
    # children of touched folders, but for touched folders and changed files themselves
    inside = old.join(touched, F.col("parent") == F.col("folder"), "left_semi").drop("part")
    full = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws("/", "parent", "name"))
    still = inside.join(touched, (F.col("kind") == "folder") & (full == F.col("folder")), "left_anti").join(changed.select("parent", "name", "kind"), ["parent", "name", "kind"], "left_anti").select(inside.columns)
    return folded(spark, changed.filter("digest IS NOT NULL"), kept(still, "tree-beside")), parts
