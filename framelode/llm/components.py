"""Problem 4: one group id for all records that are linked directly or through others.

Each round every node takes the smallest label among its neighbours, pointer jumping
shortens the chains this makes, and edges are rewritten to the labels of their ends;
edges inside a label vanish. Every round's tables are written to the shared folder, and
the rounds end when no edge, and so no label that could change, is left. Minima are
combined before the shuffle; the joins have one side with unique keys, and a label that
holds a large share of all nodes is split by the skew join of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.operators.components import connected_components
from framelode.runtime import Scratch

_UNIT = r"(?<![0-9a-z_])(vu_[0-9a-f]{24})(?![0-9a-z_])"
NO_GROUP = ("", "none", "null", "nan")


def unit_ids(c: Column) -> Column:
    """The unit ids that ``c`` names, in whatever notation, in lower case: ``vu_`` and exactly 24 hex digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(_UNIT), 1))


def unit_links(rows: DataFrame) -> DataFrame:
    """Edges ``a, b`` from a unit to each unit its row names, and to a node for its duplicate group.

    Group nodes start with ``~`` and so sort after every unit: they carry a link
    between all rows of a group with one edge a row, and never become a label.
    """
    from framelode.llm.cleaning import strip

    group = F.lower(strip(F.col("duplicate_group_id")))
    named = F.concat(
        F.coalesce(unit_ids(F.col("canonical_visual_unit_id")), F.array().cast("array<string>")),
        F.coalesce(unit_ids(F.col("duplicate_reverse_visual_unit_ids")), F.array().cast("array<string>")),
        F.when(group.isNotNull() & ~group.isin(*NO_GROUP), F.array(F.concat(F.lit("~"), group))).otherwise(F.array().cast("array<string>")),
    )
    own = F.get(unit_ids(F.col("visual_unit_id")), 0)
    return rows.select(own.alias("a"), F.explode(named).alias("b"))


def unit_groups(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``visual_unit_id, group_id`` of every unit in a group of two or more units.

    Rows whose own id is null or broken link nothing; units that are only named count too.
    """
    scratch = scratch or Scratch(rows.sparkSession, "units")
    units = connected_components(unit_links(rows), scratch=scratch).where(F.col("node").startswith("vu_"))
    # A group node with one unit makes a component of one unit, which is its own label.
    alone = units.groupBy("label").agg(F.count("*").alias("n")).where("n = 1").select(F.col("label").alias("node"))
    return units.join(alone, "node", "left_anti").select(F.col("node").alias("visual_unit_id"), F.col("label").alias("group_id"))
