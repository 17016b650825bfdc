"""Nested configuration documents: taken apart to paths, overridden by path, put together again for each set.

A path is an array of keys. A leaf is what no key leads further from: text, number, flag, null, an array as a whole, or an
empty object. Values are JSON text throughout, so that kinds of values stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.sources.results import stored

PATH = "path"


def _is_object(value: Column) -> Column:
    """Whether JSON text is an object with keys."""
    return F.regexp_like(value, F.lit(r"^\s*\{\s*[^}\s]"))


def config_leaves(documents: DataFrame, json: str = "config", keys: Sequence[str] = (), root: str | None = None) -> DataFrame:
    """``(keys, path, value)`` of every leaf of the documents, told apart by ``keys``.

    Objects are opened a level at a time until none is left, as deep as the deepest document. A ``root`` column holds the path
    that each document stands at. A null document has no leaves; text that is not JSON fails.
    """
    start = F.col(root) if root else F.array().cast("array<string>")
    level = documents.where(F.col(json).isNotNull()).select(*keys, start.alias(PATH), F.to_json(F.parse_json(json)).alias("value"))
    leaves = level.where(~_is_object(F.col("value")))
    while True:
        level = stored(level.where(_is_object(F.col("value"))), "config-level")
        if level.isEmpty():
            return leaves
        inner = level.select(*keys, PATH, F.parse_json("value").alias("_v")).lateralJoin(
            level.sparkSession.tvf.variant_explode(F.col("_v").outer())
        )
        level = inner.select(*keys, F.array_append(PATH, F.col("key")).alias(PATH), F.to_json("value").alias("value"))
        leaves = leaves.unionByName(level.where(~_is_object(F.col("value"))))


def override_paths(base: DataFrame, overrides: DataFrame, sets: DataFrame, set_id: str) -> DataFrame:
    """``(set_id, path, value)``: the leaves of each set's document.

    ``base`` has ``(path, value)``. ``overrides`` has ``(set_id, layer, path, value)``: a value, objects too, takes the place of all
    that stands at its path and below; a higher layer beats a lower one, the base is below all. A path that the
    base lacks is added. Two overrides of one set and layer fail if one stands at or below the other's path. ``sets`` names all sets; overrides
    of other sets are left out. Null values are JSON null.
    """
    ids = sets.select(set_id).distinct()
    own = overrides.select(set_id, "layer", PATH, F.coalesce("value", F.lit("null")).alias("value")).join(ids, set_id, "left_semi")
    own = stored(own, "config-overrides")
    inner = config_leaves(own, "value", (set_id, "layer"), PATH)
    whole = ids.withColumn("_document", F.lit(0)).join(base.withColumn("_document", F.lit(0)), "_document").select(
        set_id, F.lit(None).cast("int").alias("layer"), PATH, "value"
    )
    every = whole.unionByName(inner.withColumn("layer", F.col("layer").cast("int")))
    # The override that decides a leaf stands at one of the places on the way to it.
    ways = F.transform(F.sequence(F.lit(0), F.size(PATH)), lambda n: F.slice(F.col(PATH), F.lit(1), n))
    placed = every.withColumn("_way", F.explode(ways))
    marks = own.select(set_id, F.col(PATH).alias("_way"), F.col("layer").cast("int").alias("_by"))
    met = placed.join(marks, [set_id, "_way"], "left").groupBy(set_id, "layer", PATH, "value").agg(
        F.max("_by").alias("_top"), F.array_sort(F.collect_list("_by")).alias("_all")
    )
    twice = F.size(F.filter("_all", lambda b: b == F.col("_top"))) > 1
    wrong = F.raise_error(F.concat(F.lit("two overrides of one set and layer meet at "), F.concat_ws(".", PATH)))
    checked = F.when(twice, wrong.cast("string")).otherwise(F.col("value"))
    kept = F.col("_top").isNull() | F.col("layer").eqNullSafe(F.col("_top"))
    return met.withColumn("value", checked).where(kept & F.col("value").isNotNull()).select(set_id, PATH, "value")


def build_documents(leaves: DataFrame, keys: Sequence[str], name: str = "config") -> DataFrame:
    """``(keys, name)``: one JSON text for each set of leaves, its keys in order at every level.

    Objects are put together from the deepest level up, each from its own children. Two values at one path, or a value
    above another, fail.
    """
    deepest = leaves.agg(F.max(F.size(PATH))).first()[0]
    key = F.to_json(F.array(F.element_at(PATH, -1)))
    field = F.concat(F.substring(key, F.lit(2), F.length(key) - 2), F.lit(":"), F.col("value"))
    wrong = F.raise_error(F.concat(F.lit("two values stand at "), F.concat_ws(".", PATH))).cast("string")

    def single(rows: DataFrame) -> DataFrame:
        """One value for each path; an empty object gives way to what was put into it."""
        held = rows.groupBy(*keys, PATH).agg(F.collect_list("value").alias("_v"))
        full = F.filter("_v", lambda v: v != "{}")
        value = F.when(F.size(full) > 1, wrong).otherwise(F.coalesce(F.get(full, F.lit(0)), F.lit("{}")))
        return held.select(*keys, PATH, value.alias("value"))

    rest = leaves.select(*keys, PATH, "value")
    for depth in range(deepest or 0, 0, -1):
        here = single(rest.where(F.size(PATH) == depth))
        children = here.select(*keys, F.slice(PATH, 1, depth - 1).alias("_parent"), F.struct(F.element_at(PATH, -1).alias("k"), field.alias("f")).alias("_c"))
        fields = F.transform(F.array_sort(F.collect_list("_c")), lambda c: c["f"])
        built = children.groupBy(*keys, "_parent").agg(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("value"))
        rest = rest.where(F.size(PATH) < depth).unionByName(built.withColumnRenamed("_parent", PATH))
    return single(rest).select(*keys, F.col("value").alias(name))
