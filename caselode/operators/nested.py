"""Nested records: ordered maps with repeated keys, order-keeping dedupe of structs, types of ids, typed reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.sources.tables import read_jsonl

MEDICINE = "CMAN string, caution array<struct<caution_level:string,caution_levelid:string,crowd:string,crowd_id:string>>, drugid string, ingredients array<struct<ingredient_id:string,ingredient:string>>, interaction array<struct<interaction_id:string,name:string>>, name string, treat array<struct<treat:string,treat_id:string>>"
PATIENT = f"age bigint, allergen array<string>, antecedents array<string>, diagnosis array<string>, gender string, `group` array<string>, id string, medicine array<struct<{MEDICINE}>>, on_medicine array<struct<{MEDICINE}>>, part string, symptom array<string>"
SAMPLE = f"people struct<{PATIENT}>, top_k_drugs map<string,struct<{MEDICINE}>>"


def distinct_by(items: Column | str, *keys: str) -> Column:
    """The first item of each key in an array of structs, in order; null keys are one key."""
    items = F.col(items) if isinstance(items, str) else items
    named = F.transform(items, lambda x: F.to_json(F.struct(*[x[k].alias(k) for k in keys]), {"ignoreNullFields": "false"}))
    return F.filter(F.transform(F.arrays_zip(items.alias("x"), named.alias("k")), lambda z, i: F.when(F.array_position(named, z["k"]) == i + 1, z["x"])), lambda x: x.isNotNull())


def ordered_entries(entries: Column) -> Column:
    """(rank, key, value) of a map's entries as written: a repeated key keeps its first place and has its last value."""
    keys = F.transform(entries, lambda e: e["key"])
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.transform(F.array_distinct(keys), lambda k, i: F.struct((i + 1).cast("int").alias("rank"), k.alias("key"), last(k).alias("value")))


def as_candidates(samples: DataFrame, drugs: str = "top_k_drugs") -> DataFrame:
    """``samples`` with ``candidates``, an array of (rank, drugid, drug), in place of the map."""
    found = F.transform(ordered_entries(F.map_entries(drugs)), lambda e: F.struct(e["rank"].alias("rank"), e["key"].alias("drugid"), e["value"].alias("drug")))
    return samples.withColumn("candidates", found).drop(drugs)


def normal_medicine(drug: Column) -> Column:
    """Ids as text, ids of crowds and levels as whole numbers where they are some; lists that are null are empty."""
    rows = lambda c, kind: F.coalesce(drug[c], F.array().cast(kind))
    caution = "array<struct<caution_level:string,caution_levelid:string,crowd:string,crowd_id:string>>"
    return F.struct(
        drug["CMAN"].alias("CMAN"),
        F.transform(rows("caution", caution), lambda x: F.struct(x["caution_level"].alias("caution_level"), T.lenient_int(x["caution_levelid"]).alias("caution_levelid"), x["crowd"].alias("crowd"), T.lenient_int(x["crowd_id"]).alias("crowd_id"))).alias("caution"),
        drug["drugid"].cast("string").alias("drugid"),
        F.transform(rows("ingredients", "array<struct<ingredient_id:string,ingredient:string>>"), lambda x: F.struct(T.lenient_int(x["ingredient_id"]).alias("ingredient_id"), x["ingredient"].alias("ingredient"))).alias("ingredients"),
        F.transform(rows("interaction", "array<struct<interaction_id:string,name:string>>"), lambda x: F.struct(T.lenient_int(x["interaction_id"]).alias("interaction_id"), x["name"].alias("name"))).alias("interaction"),
        drug["name"].alias("name"),
        F.transform(rows("treat", "array<struct<treat:string,treat_id:string>>"), lambda x: F.struct(x["treat"].alias("treat"), T.lenient_int(x["treat_id"]).alias("treat_id"))).alias("treat"),
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples out of JSON lines: (people, candidates) with normal medicines; a line of another form fails."""
    rows = as_candidates(read_jsonl(spark, path, SAMPLE))
    normal = F.transform("candidates", lambda c: F.struct(c["rank"].alias("rank"), c["drugid"].alias("drugid"), normal_medicine(c["drug"]).alias("drug")))
    return rows.withColumn("candidates", normal)
