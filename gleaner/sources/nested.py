"""Walks through JSON of unknown shape, as VARIANT values: a level at a time, all documents at once, inside Spark's engine.

Each level explodes the lists and objects that the last one has found; a level is kept in the shared folder before the
next, and the walk ends with the deepest document. A text that isn't JSON has no values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.lineage import settled

# Types of linked data that are businesses, and those that hold others in one field.
BUSINESSES = ("LocalBusiness", "Organization", "Hotel", "Store", "ProfessionalService")
HOLDERS = ("SearchResultsPage", "FAQPage")


def _kind(v: str) -> Column:
    """ARRAY, OBJECT, STRING or another type's name."""
    return F.regexp_extract(F.schema_of_variant(F.col(v)), "^[A-Z]+", 0)


def _below(df: DataFrame) -> DataFrame:
    """df with its lists' and objects' (v) members as v, key and pos in their places; other values have none."""
    spark = df.sparkSession
    found = df.withColumnRenamed("v", "_around").drop("key")
    return found.lateralJoin(spark.tvf.variant_explode(F.col("_around").outer())).withColumnRenamed("value", "v").drop("_around")


def walk(documents: DataFrame, payload: str, *keep: str) -> DataFrame:
    """A row per value that is no list or object: keep, path (places from the top; an object's members by name), key (null in a list), value (a string), kind."""
    level = documents.select(*keep, F.try_parse_json(payload).alias("v")).filter(F.col("v").isNotNull())
    level = level.withColumns({"path": F.array().cast("array<int>"), "key": F.lit(None).cast("string")}).withColumn("kind", _kind("v"))
    parts = []
    while True:
        level = settled(level)
        inner = F.col("kind").isin("ARRAY", "OBJECT")
        parts.append(level.filter(~inner).select(*keep, "path", "key", F.expr("try_variant_get(v, '$', 'string')").alias("value"), "kind"))
        groups = level.filter(inner)
        if groups.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        level = _below(groups).withColumn("path", F.concat("path", F.array("pos"))).drop("pos").withColumn("kind", _kind("v"))


def place_addresses(documents: DataFrame, payload: str, *keep: str) -> DataFrame:
    """keep, place_url: the map places that texts at any depth name, once each (without regard to case and what follows ?), in the order of the walk, as place."""
    from pyspark.sql import Window

    texts = walk(documents, payload, *keep).filter("kind = 'STRING'")
    own = texts.select(*keep, "path", F.trim("value").alias("place_url")).filter(F.contains("place_url", F.lit("/maps/place/")))
    key = F.split(F.lower("place_url"), "[?]")[0]
    first = own.groupBy(*keep, key.alias("_key")).agg(F.min(F.struct("path", "place_url")).alias("_first"))
    order = Window.partitionBy(*keep).orderBy("_first")
    return first.select(*keep, (F.row_number().over(order) - 1).alias("place"), F.col("_first.place_url").alias("place_url"))


def businesses(documents: DataFrame, payload: str, *keep: str) -> DataFrame:
    """keep, path, item: the businesses (variants) of linked data, wherever lists, graphs, item lists and result pages hold them; a business's own parts aren't looked into."""
    level = documents.select(*keep, F.try_parse_json(payload).alias("v")).filter(F.col("v").isNotNull()).withColumn("path", F.array().cast("array<int>"))
    get = lambda at, kind="variant": F.expr(f"try_variant_get(v, '{at}', '{kind}')")
    parts = []
    while True:
        level = settled(level.withColumns({"kind": _kind("v"), "type": get("$[\"@type\"]", "string")}))
        own = level.filter((F.col("kind") == "OBJECT") & F.col("type").isin(*BUSINESSES))
        parts.append(own.select(*keep, "path", F.col("v").alias("item")))
        inside = (
            F.when(F.col("kind") == "ARRAY", F.col("v"))
            .when(F.col("type") == "ItemList", get("$.itemListElement"))
            .when(F.col("type").isin(*HOLDERS), get("$.mainEntity"))
            .when(F.col("type") == "ListItem", get("$.item"))
            .when(F.col("type").isin(*BUSINESSES), F.lit(None).cast("variant"))
            .otherwise(get("$[\"@graph\"]"))
        )
        # An item list's elements are taken by their item, whatever they call themselves.
        listed = F.col("type") == "ItemList"
        rest = level.withColumns({"_listed": F.coalesce(listed, F.lit(False)), "v": inside}).filter(F.col("v").isNotNull()).withColumn("kind", _kind("v"))
        many = _below(rest.filter("kind = 'ARRAY'").select(*keep, "path", "_listed", "v")).withColumn("path", F.concat("path", F.array("pos"))).drop("pos", "key")
        one = rest.filter("kind = 'OBJECT' and not _listed").select(*keep, F.concat("path", F.array(F.lit(0))).alias("path"), "_listed", "v")
        level = many.unionByName(one).withColumn("v", F.when(F.col("_listed"), F.when(_kind("v") == "OBJECT", get("$.item"))).otherwise(F.col("v"))).drop("_listed").filter(F.col("v").isNotNull())
        if level.isEmpty():
            return reduce(DataFrame.unionByName, parts)
