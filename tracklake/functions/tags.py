"""Road classes by suitability for cycling."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of highway tags.
HIGHWAY_CLASSES = {
    "never": (
        "motorway",
        "motorway_link",
        "trunk",
        "trunk_link",
        "primary",
        "primary_link",
        "steps",
    ),
    "link": (
        "secondary",
        "secondary_link",
        "tertiary",
        "tertiary_link",
        "unclassified",
        "residential",
        "service",
        "living_street",
        "pedestrian",
        "track",
        "road",
        "footway",
        "path",
    ),
    "must": ("cycleway",),
}


def highway_class(value: Column) -> Column:
    """never, link or must for a known highway value, else null: a constant map, so no join."""
    pairs = [(v, name) for name, values in HIGHWAY_CLASSES.items() for v in values]
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])
    return F.try_element_at(table, value)
