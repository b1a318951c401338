"""Reading and checking loosely structured model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("characters", "places", "objects", "factions", "events", "world_rules", "plot_arcs")
TYPE_OF = {"characters": "character", "places": "place", "objects": "object", "factions": "faction", "events": "event", "world_rules": "world_rule", "plot_arcs": "plot_arc"}
ENTITY = "array<struct<name:string,description:string,status:string,confidence:double>>"
EXTRACTION = "struct<" + ",".join(f"{c}:{ENTITY}" for c in CATEGORIES) + ">"


def parse_json_loose(text: Column, schema: str) -> Column:
    """JSON as it stands, else without code fences, else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    read = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema))
    return F.coalesce(read(text), read(bare))


def flatten_extractions(raw: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each entity, categories in their fixed order; a confidence that was left out stays null."""
    told = raw.select(key, parse_json_loose(F.col(text), EXTRACTION).alias("x"))
    row = lambda kind: lambda e: F.struct(F.lit(kind).alias("type"), e["name"].alias("name"), e["description"].alias("description"), e["status"].alias("status"), e["confidence"].alias("confidence"))
    kinds = [F.transform(F.coalesce(F.col(f"x.{c}"), F.array().cast(ENTITY)), row(TYPE_OF[c])) for c in CATEGORIES]
    return told.select(key, F.posexplode(F.concat(*kinds)).alias("seq", "e")).select(key, "seq", "e.*")


def validate_entities(df: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a name and a type of the vocabulary, and the others with a reason."""
    reason = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "empty name").when(~F.coalesce(F.col("type").isin(types), F.lit(False)), "unknown type")
    told = df.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def validate_relations(df: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with both ends and a relation of the vocabulary, and the others with a reason."""
    reason = F.when(F.col("src").isNull() | F.col("dst").isNull(), "missing end").when(~F.coalesce(F.col("rel_type").isin(kinds), F.lit(False)), "unknown type")
    told = df.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def gate(df: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Confidence 1 if left out and 1 at most; empty and archived statuses are active; unsure rows are candidates."""
    sure = F.least(F.coalesce("confidence", F.lit(1.0)), F.lit(1.0))
    status = F.when(F.coalesce("status", F.lit("")).isin("", "archived"), "active").otherwise(F.col("status"))
    return df.withColumn("confidence", sure).withColumn("status", F.when(F.col("confidence") < threshold, "candidate").otherwise(status))


def normalize_taxonomy(value: Column, mapping: dict[str, str], default: str) -> Column:
    """Old names mapped, names of the vocabulary kept, anything else the default."""
    low = F.lower(F.trim(value))
    out = F.when(low.isin(sorted(set(mapping.values()))), low)
    for old, new in mapping.items():
        out = out.when(low == old, new)
    return out.otherwise(default)


def valid_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def guard_dims(df: DataFrame, dims: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the right length, and the others."""
    ok = F.coalesce(F.size(column) == dims, F.lit(False))
    return df.where(ok), df.where(~ok)


def prop(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}")


def num_prop(text: Column, key: str) -> Column:
    return prop(text, key).cast("double")
