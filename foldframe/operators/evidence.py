"""Evidence cards: what is known of a reference residue in a pair, and how complete it is. No effect is scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTIONS = ("sequence", "structure", "interactions", "site")
SCHEMA_VERSION = "3.0"


def cards(keys: DataFrame, sequence: DataFrame | None = None, structure: DataFrame | None = None, interactions: DataFrame | None = None, site: DataFrame | None = None) -> DataFrame:
    """keys (pair_id, target_id, reference_key, reference_name) with a struct for each section, null where there is none.

    Each section is a table by pair_id and reference_key with at most one row
    for each. overall_status is available if all sections are there, partial if
    some are, else unavailable; source_count is their number.
    """
    out = keys
    for name, table in zip(SECTIONS, (sequence, structure, interactions, site), strict=True):
        if table is None:
            out = out.withColumn(name, F.lit(None).cast("struct<none:string>"))
            continue
        fields = [c for c in table.columns if c not in ("pair_id", "reference_key")]
        out = out.join(table.select("pair_id", "reference_key", F.struct(*fields).alias(name)), ["pair_id", "reference_key"], "left")
    there = F.filter(F.array(*[F.when(F.col(s).isNotNull(), s) for s in SECTIONS]), lambda s: s.isNotNull())
    missing = F.array_except(F.array(*[F.lit(s) for s in SECTIONS]), F.col("available_sections"))
    n = F.size("available_sections")
    out = out.withColumn("available_sections", there).withColumn("unavailable_sections", missing)
    out = out.withColumns({"source_count": n, "overall_status": F.when(n == len(SECTIONS), "available").when(n > 0, "partial").otherwise("unavailable"), "schema_version": F.lit(SCHEMA_VERSION)})
    # The wording of a card.
    said = F.format_string("Reference %s · target %s · evidence %s", F.coalesce("reference_name", F.lit("unknown")), F.coalesce("target_id", F.lit("unavailable")), "overall_status")
    return out.withColumn("text", said)
