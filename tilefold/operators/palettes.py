"""First-fit packing of colour sets into palettes by a log of changes.

A set goes to the first palette that covers it, else to the first whose union with it fits, else to
a new one. Palettes only grow, and once a set has been placed some palette covers it for good, so
only the first occurrence of a distinct set can change anything. Those alone are folded, as a
stream in scan order that holds nothing but the palettes; each change is written down. A block
then takes, as of its position, the first palette that covers its set (by then an earlier palette
may have grown over it), which is a join of distinct sets with the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..working import stored

#: Stands for the colour of an empty set.
_NONE = -(1 << 31)


def change_log(distinct: DataFrame, capacity: int, image: str = "image_id") -> DataFrame:
    """(image, position, palette, colors): the palettes' contents after each change.

    ``distinct``: image, colors (sorted), position of the first block that has them.
    """
    kind = distinct.schema[image].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, palettes = object(), []
        for batch in batches:
            changes = []
            for name, position, colors in zip(*(batch.column(c).to_pylist() for c in (image, "position", "colors")), strict=True):
                if name != current:
                    current, palettes = name, []
                chosen = place(palettes, frozenset(colors), capacity)
                if chosen is not None:
                    changes.append((name, position, chosen, sorted(palettes[chosen])))
            if changes:
                columns = list(zip(*changes, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(image).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.int32()))], [image, "position", "palette", "colors"])

    ordered = distinct.select(image, "position", "colors").repartition(image).sortWithinPartitions(image, "position")
    return ordered.mapInArrow(fold, f"{image} {kind}, position long, palette int, colors array<int>")


def place(palettes: list[frozenset], colors: frozenset, capacity: int) -> int | None:
    """The palette that ``colors`` change (``palettes`` is updated), if they change any."""
    if len(colors) > capacity or any(colors <= p for p in palettes):
        return None
    for i, p in enumerate(palettes):
        if len(p | colors) <= capacity:
            palettes[i] = p | colors
            return i
    palettes.append(colors)
    return len(palettes) - 1


def _any_color(colors: Column) -> Column:
    """One colour of a set, not the same for most sets, or the mark of the empty set."""
    return F.coalesce(F.array_min(F.transform(colors, lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("c"))))["c"], F.lit(_NONE))


def first_fit(sets: DataFrame, capacity: int, image: str = "image_id") -> DataFrame:
    """(image, block, palette) of sets (image, block, colors of distinct ints); -1 for sets over capacity."""
    rows = sets.select(image, F.col("block").cast("long").alias("block"), F.array_sort(F.col("colors").cast("array<int>")).alias("colors"))
    distinct = stored(rows.groupBy(image, "colors").agg(F.min("block").alias("position")))
    log = stored(change_log(distinct, capacity, image))
    by_color = log.select(image, "position", "palette", F.col("colors").alias("held"), F.explode(F.concat("colors", F.array(F.lit(_NONE)))).alias("one"))
    covered = distinct.select(image, "colors", _any_color(F.col("colors")).alias("one")).join(by_color, [image, "one"]).where(F.size(F.array_except("colors", "held")) == 0)
    since = covered.groupBy(image, "colors", "palette").agg(F.min("position").alias("position"))  # palettes only grow
    steps = since.groupBy(image, "colors").agg(F.collect_list(F.struct("palette", "position")).alias("steps"))  # a row for each palette at most
    known = F.filter("steps", lambda s: s["position"] <= F.col("block"))
    palette = F.coalesce(F.array_min(F.transform(known, lambda s: s["palette"])), F.lit(-1))
    return rows.join(steps, [image, "colors"], "left").select(image, "block", palette.alias("palette"))
