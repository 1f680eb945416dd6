"""Statements of a knowledge base in one line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# The properties that are told, in order.
PROPERTIES = {"P569": "出生", "P570": "死亡", "P571": "成立", "P576": "解散", "P27": "国籍", "P31": "类型", "P106": "职业"}
_ENTITIES = "map<string, struct<claims: map<string, array<struct<rank: string, mainsnak: struct<datavalue: struct<type: string, value: string>>>>>, labels: map<string, struct<value: string>>>>"


def claim_summary(entities: Column, qid: Column) -> Column:
    """The first preferred statement of each property, else its first one; items by their Chinese or English label. Empty without any."""

    def told(all_of: Column) -> Column:
        return F.array_join(F.array_compact(F.array(*(one(all_of, F.try_element_at(all_of, qid).claims, p, name) for p, name in PROPERTIES.items()))), "；")

    def one(all_of: Column, claims: Column, p: str, name: str) -> Column:
        rows = F.try_element_at(claims, F.lit(p))
        best = F.coalesce(F.get(F.filter(rows, lambda r: r["rank"] == "preferred"), 0), F.get(rows, 0)).mainsnak.datavalue
        return bound(bound(best, value), lambda v: F.when(v != "", F.concat(F.lit(f"{name} "), F.when(v.startswith("Q"), label(all_of, v)).otherwise(v))))

    def value(v: Column) -> Column:
        time = F.get_json_object(v.value, "$.time")
        year = F.regexp_replace(F.regexp_extract(time, r"^([+-]?[0-9]{4})", 1), r"^\+", "")
        when = F.when(year != "", year).otherwise(F.left(F.regexp_replace(time, r"^\+", ""), F.lit(10)))
        return F.coalesce(F.when(v.type == "time", when).when(v.type == "wikibase-entityid", F.get_json_object(v.value, "$.id")).when(~v.value.rlike(r"^[\[{]"), v.value), F.lit(""))

    def label(all_of: Column, v: Column) -> Column:
        labels = F.try_element_at(all_of, v).labels
        return F.coalesce(F.try_element_at(labels, F.lit("zh")).value, F.try_element_at(labels, F.lit("en")).value, v)

    return F.coalesce(bound(F.from_json(entities, _ENTITIES), told), F.lit(""))
