"""Seamark types out of GeoJSON properties.

Three readings differ on purpose, as the places that use them do. Each takes
``direct`` (the property itself), ``parsed`` (map of parsed tags) and ``raw``
(tags as "key"=>"value" text); nulls mean absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = "seamark:type"
_PATTERN = r'"seamark:type"=>"([^"]+)"'
LANE = "separation_lane"
UNKNOWN = "unknown"


def tag_in_text(raw: Column) -> Column:
    """The quoted value after the quoted key; null if there is none."""
    return F.nullif(F.regexp_extract(raw, _PATTERN, 1), F.lit(""))


def tags_of_text(raw: Column) -> Column:
    """All "key"=>"value" pairs as a map; later pairs win."""
    pairs = F.regexp_extract_all(raw, F.lit(r'"([^"]+)"=>"([^"]*)"'), F.lit(0))
    entry = lambda p: F.struct(F.regexp_extract(p, r'"([^"]+)"=>', 1).alias("k"), F.regexp_extract(p, r'=>"([^"]*)"', 1).alias("v"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(F.coalesce(last, F.array().cast("array<struct<k:string,v:string>>")))


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def type_for_mask(direct: Column, parsed: Column, raw: Column) -> Column:
    """Combined mask: direct, then parsed, then text; otherwise ``unknown``, which counts as no-go."""
    return F.coalesce(_present(direct), _present(F.try_element_at(parsed, F.lit(KEY))), tag_in_text(raw), F.lit(UNKNOWN))


def type_for_index(direct: Column, parsed: Column, raw: Column) -> Column:
    """Lane index: the first source that is there decides, even if it lacks the key."""
    return F.when(direct.isNotNull(), direct).when(parsed.isNotNull(), F.try_element_at(parsed, F.lit(KEY))).otherwise(tag_in_text(raw))


def type_for_overlay(direct: Column, parsed: Column, raw: Column, alternative: Column | None = None) -> Column:
    """Mask overlay: parsed, then direct, then what follows the key's next two quotes in the text."""
    rest = F.when(F.contains(raw, F.lit(KEY)), F.split(F.substring_index(raw, KEY, -1), '"', 4)[2])
    others = [_present(alternative)] if alternative is not None else []
    return F.coalesce(_present(F.try_element_at(parsed, F.lit(KEY))), _present(direct), *others, rest)


def layer_colour(kind: Column) -> Column:
    """Plot layer of a feature: lanes, lines and boundaries, everything else."""
    return F.when(kind == LANE, "lane").when(kind.isin("separation_line", "separation_boundary"), "boundary").otherwise("other")
