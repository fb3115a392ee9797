"""Mutation events: descriptions of correspondence rows, never scores of effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.functions.lookups import THREE_LETTERS, is_canonical, substitution_class, substitution_table


def detect(rows: DataFrame) -> DataFrame:
    """One event for each row but unmapped ones: kind, notation and, for substitutions alone, blosum62, grantham and class.

    Needs pair_id, alignment_index, status, reference/target _aa, _key, _name, _num.
    """
    own = rows.filter("status <> 'unmapped'")
    standard = lambda side: F.col(f"{side}_key").isNull() | (F.upper(f"{side}_name").isin(*THREE_LETTERS.values()) & is_canonical(F.upper(f"{side}_aa")))
    kind = F.when((F.col("status") == "nonstandard") | ~standard("reference") | ~standard("target"), "nonstandard").otherwise(F.col("status"))
    letter = lambda side: F.coalesce(F.upper(f"{side}_aa"), F.lit("?"))
    number = lambda side: F.coalesce(f"{side}_num", F.lit("-"))
    named = lambda side: F.coalesce(f"{side}_name", F.upper(f"{side}_aa"), F.lit("?"))
    notation = (
        F.when(F.col("kind").isin("conserved", "substitution"), F.concat(letter("reference"), number("reference"), letter("target")))
        .when(F.col("kind") == "insertion", F.concat(F.lit("insertion:"), letter("target"), F.lit(":"), number("target")))
        .when(F.col("kind") == "deletion", F.concat(F.lit("Δ"), F.coalesce(F.initcap("reference_name"), F.lit("?")), number("reference")))
        .otherwise(F.concat(F.lit("nonstandard:"), named("reference"), F.lit(":"), number("reference"), F.lit("->"), named("target"), F.lit(":"), number("target")))
    )
    table = substitution_table(rows.sparkSession).select(F.col("reference_aa").alias("_a"), F.col("target_aa").alias("_b"), "blosum62", "grantham")
    swap = F.col("kind") == "substitution"
    events = own.withColumn("kind", kind).withColumn("notation", notation)
    events = events.join(F.broadcast(table), swap & (F.upper("reference_aa") == F.col("_a")) & (F.upper("target_aa") == F.col("_b")), "left")
    return events.select(
        "pair_id", "alignment_index", "kind", F.col("reference_label"), F.col("target_label"), "notation", "blosum62", "grantham",
        F.when(swap, substitution_class(F.col("reference_aa"), F.col("target_aa"))).alias("class"),
    )
