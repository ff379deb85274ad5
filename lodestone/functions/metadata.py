"""Metadata maps and flat payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Payload fields that belong to the chunk itself.
OWN = ("chunk_id", "doc_id", "position", "content")


def flatten(metadata: Column, **own: Column) -> Column:
    """One payload map: the chunk's own fields as text, then the metadata; own fields win over metadata of the same name."""
    mine = F.map_from_arrays(F.array(*(F.lit(k) for k in own)), F.array(*(v.cast("string") for v in own.values())))
    rest = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*own))
    return F.map_concat(mine, rest)


def unflatten(payload: Column, own: tuple[str, ...] = OWN) -> Column:
    """The metadata of a payload: what isn't one of the chunk's own fields."""
    return F.map_filter(payload, lambda k, v: ~k.isin(*own))
