"""Schema discovery for JSON zones (A5): a mergeable summary and a catalog with history.

A summary has one row per field path with the set of JSON kinds seen there
and how often. Summaries of parts of a zone merge by union, so parts can be
crawled on their own and folded in any order. Paths of nested objects are
dotted, array elements are ``path[]``. A column's type is the join of its
kinds in a small lattice: VOID < everything, BIGINT < DOUBLE, and VARIANT
above kinds that have no other common type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED_FOLDERS = ("_temporary", "errors")
CATALOG_SCHEMA = "path string, type string, status string, first_crawl long, last_crawl long"


def zone_lines(spark: SparkSession, path: str, excluded: tuple[str, ...] = EXCLUDED_FOLDERS) -> DataFrame:
    """The JSON lines of a zone as ``value``, without files below excluded folders; partition columns are not read."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    file = F.col("_metadata.file_path")
    for folder in excluded:
        lines = lines.where(~file.contains(f"/{folder}/"))
    return lines.select("value")


def _type_name(value: Column) -> Column:
    """The type of a variant up to what a container holds: BIGINT, DECIMAL(3,1), OBJECT."""
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def _kind(type_name: Column) -> Column:
    t = F.regexp_extract(type_name, "^[A-Z]+", 0)
    return (F.when(t.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "BIGINT")
            .when(t.isin("FLOAT", "DOUBLE", "DECIMAL"), "DOUBLE").otherwise(t))


def schema_summary(lines: DataFrame, json_col: str = "value") -> DataFrame:
    """``(path, kinds, n)`` of a column of JSON texts; texts that are no object are left out.

    One pass per nesting level; a level is reduced to (path, kind) counts in
    each task before anything is shuffled, and the counts are kept: they say
    whether there is another level, and no use of the summary reads the texts
    again.
    """
    level = lines.select(F.lit("").alias("_at"), F.try_parse_json(F.col(json_col)).alias("_v"))
    # Only objects become maps; a text that is none has no fields.
    level = level.select("_at", "_v", F.lit("OBJECT").alias("_t"))
    parts = []
    while not parts or not parts[-1].where(F.col("kind").isin("OBJECT", "ARRAY")).isEmpty():
        items = F.try_variant_get("_v", "$", "array<variant>")
        places = F.map_from_arrays(F.sequence(F.lit(1), F.size(items)).cast("array<string>"), items)
        inside = F.when(F.col("_t") == "OBJECT", F.try_variant_get("_v", "$", "map<string,variant>")).when(F.size(items) > 0, places)
        fields = level.select("_at", "_t", F.explode(inside).alias("_k", "_v"))
        path = F.when(F.col("_t") == "ARRAY", F.concat(F.regexp_replace("_at", r"\.$", ""), F.lit("[]"))).otherwise(F.concat("_at", "_k"))
        fields = fields.select(path.alias("_path"), "_v", _type_name(F.col("_v")).alias("_t"))
        parts.append(fields.groupBy(F.col("_path").alias("path"), "_t").agg(F.count(F.lit(1)).alias("n"))
                     .select("path", _kind(F.col("_t")).alias("kind"), "n").checkpoint())
        level = fields.where(F.col("_t").isin("OBJECT", "ARRAY")).select(F.concat("_path", F.lit(".")).alias("_at"), "_v", "_t")
        if len(parts) > 1:
            # Deep levels are few values; plans over all levels above them would grow too large.
            level = level.checkpoint()
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    return counts.groupBy("path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("n").alias("n"))


def merge_summaries(*summaries: DataFrame) -> DataFrame:
    """The summary of all parts from those of each."""
    rows = summaries[0]
    for s in summaries[1:]:
        rows = rows.unionByName(s)
    # The kinds are few; each part's count goes with one of them.
    each = rows.select("path", F.posexplode("kinds").alias("_i", "kind"), "n")
    return each.groupBy("path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"),
                                    F.sum(F.when(F.col("_i") == 0, F.col("n")).otherwise(0)).alias("n"))


def column_type(kinds: Column) -> Column:
    """The least type above all kinds."""
    some = F.array_remove(kinds, "VOID")
    return (F.when(F.size(some) == 0, "VOID").when(F.size(some) == 1, F.get(some, 0))
            .when(F.size(F.array_except(some, F.array(F.lit("BIGINT"), F.lit("DOUBLE")))) == 0, "DOUBLE").otherwise("VARIANT"))


def update_catalog(catalog: DataFrame | None, summary: DataFrame, crawl: int) -> tuple[DataFrame, DataFrame]:
    """(new catalog, changes of this crawl).

    New columns are added and types updated; a column that vanished stays
    with status ``deprecated``. ``change`` is added, updated, deprecated,
    returned (with or without a new type) or unchanged.
    """
    new = summary.select("path", column_type(F.col("kinds")).alias("_new"))
    old = catalog if catalog is not None else summary.sparkSession.createDataFrame([], CATALOG_SCHEMA)
    both = old.join(new, "path", "full_outer")
    here, known = F.col("_new").isNotNull(), F.col("type").isNotNull()
    change = (F.when(~known, "added").when(~here, F.when(F.col("status") == "deprecated", "unchanged").otherwise("deprecated"))
              .when(F.col("status") == "deprecated", "returned").when(F.col("type") != F.col("_new"), "updated").otherwise("unchanged"))
    both = both.withColumn("change", change)
    changes = both.select("path", "change", F.col("type").alias("old_type"), F.col("_new").alias("new_type"))
    kept = both.select("path", F.coalesce("_new", "type").alias("type"), F.when(here, "active").otherwise("deprecated").alias("status"),
                       F.coalesce("first_crawl", F.lit(crawl).cast("long")).alias("first_crawl"),
                       F.when(here, F.lit(crawl).cast("long")).otherwise(F.col("last_crawl")).alias("last_crawl"))
    return kept, changes
