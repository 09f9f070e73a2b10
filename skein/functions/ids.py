"""Content identities."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(kind: str, text: Column) -> Column:
    """`kind-` and the SHA-256 of `kind-text`."""
    return F.concat(F.lit(f"{kind}-"), F.sha2(F.concat(F.lit(f"{kind}-"), text), 256))


def hyperedge_id(text: Column, entities: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", text, F.array_sort(entities))), 1, 16)


def hyper_entity_id(entity: Column) -> Column:
    return F.substring(F.md5(F.lower(entity)), 1, 16)


def content_hash(text: Column) -> Column:
    return F.md5(text)
