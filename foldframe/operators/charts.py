"""Long tables behind charts; units stand in the column or metric names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEVIATION_METRICS = ("ca_displacement", "backbone_rmsd", "sidechain_rmsd", "all_heavy_rmsd")
COLORS = {"low": "blue", "middle": "yellow", "high": "red", "none": "slate"}
# What a viewer shows.
STATUS_COLORS = {"conserved": "slate", "substitution": "orange", "insertion": "yellow", "deletion": "red", "nonstandard": "magenta", "unmapped": "gray70"}


def status_color(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_COLORS.items() for x in kv]), status)


def label(side: str) -> Column:
    """chain:number of a side's residue, an em dash without one."""
    return F.coalesce(f"{side}_label", F.lit("—"))


def deviation_profile(rows: DataFrame, metric: str = "ca_displacement") -> DataFrame:
    """A point for each reference residue with a numeric position: target_id, x, y (null stays), label, alignment_index."""
    if metric not in DEVIATION_METRICS:
        raise ValueError(f"no such metric: {metric}")
    return rows.filter("reference_position is not null").select("pair_id", "target_id", F.col("reference_position").cast("double").alias("x"), F.col(metric).alias("y"), label("reference").alias("label"), "alignment_index")


def mutation_matrix(rows: DataFrame) -> DataFrame:
    """A cell for each reference residue and target: 1.0 if conserved else 0.0, text such as E166A or E-."""
    letters = F.when(F.col("reference_aa").isNotNull() & F.col("target_aa").isNotNull(), F.concat("reference_aa", F.regexp_extract("reference_num", "^-?[0-9]*", 0), "target_aa"))
    text = F.coalesce(letters, F.concat(F.coalesce("reference_aa", F.lit("?")), F.coalesce("target_aa", F.lit("-"))))
    return rows.filter("reference_key is not null").select("pair_id", "target_id", label("reference").alias("column_label"), F.when(F.col("status") == "conserved", 1.0).otherwise(0.0).alias("value"), text.alias("text"), "status", "alignment_index", label("target").alias("target_residue"))


def sequence_structure(summary: DataFrame, metric: str = "strict_rmsd") -> DataFrame:
    """Identity in percent against a structural metric; pairs without the metric are left out."""
    if metric not in ("tm_score", "strict_rmsd", "refined_rmsd"):
        raise ValueError(f"no such metric: {metric}")
    return summary.filter(F.col(metric).isNotNull()).select("target_id", (F.col("identity") * 100.0).alias("x"), F.col(metric).alias("y"))


def conservation_profile(positions: DataFrame) -> DataFrame:
    """Two series over common positions: variability, and coverage in percent. x is the residue number (reference_position), else the index from 1."""
    x = F.coalesce(F.col("reference_position"), F.col("position_index") + 1).cast("double").alias("x")
    series = F.array(F.struct(F.lit("variability").alias("series"), F.col("variability").alias("y")), F.struct(F.lit("coverage (%)").alias("series"), (F.col("coverage") * 100.0).alias("y")))
    return positions.select("reference_id", "position_index", x, F.explode(series).alias("s")).select("reference_id", "position_index", "x", "s.series", "s.y")


def key_residues(rows: DataFrame, keys: DataFrame, metric: str = "ca_displacement") -> DataFrame:
    """A point for each chosen reference residue (keys: reference_id, reference_key, key_ord, reference_position, reference_label) and pair; missing stays null."""
    pairs = rows.select("pair_id", "reference_id", "target_id").distinct()
    own = rows.select("pair_id", "reference_key", F.col(metric).alias("y"))
    x = F.coalesce(F.col("reference_position"), F.col("key_ord") + 1).cast("double").alias("x")
    return pairs.join(keys, "reference_id").join(own, ["pair_id", "reference_key"], "left").select("pair_id", "target_id", "key_ord", x, "y", label("reference").alias("label"))


def msa_profile(columns: DataFrame) -> DataFrame:
    """Conservation of each column, counted from 1."""
    return columns.select("alignment_id", (F.col("column_index") + 1).alias("x"), F.col("conservation").alias("y"), F.col("reference_label").alias("label"))


def symmetric_bound(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The larger of |least| and |greatest|, for a colour scale around zero."""
    return rows.groupBy(*by).agg(F.greatest(F.abs(F.min(value)), F.abs(F.max(value))).alias("bound"))


def color_bins(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds color by where a value stands between its group's extremes: under 0.34 low, under 0.67 middle, else high; a flat group is middle, null none."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    at = (F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    color = F.when(F.col(value).isNull(), COLORS["none"]).when(at.isNull(), COLORS["middle"]).when(at < 0.34, COLORS["low"]).when(at < 0.67, COLORS["middle"]).otherwise(COLORS["high"])
    return rows.join(ends, by).withColumn("color", color).drop("_low", "_high")


def selection_name(text: Column) -> Column:
    """A safe lower-case object name."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9_]+", "_"))


def residue_selection(chain: Column, number: Column) -> Column:
    """Selection text of a residue; null for a name with a quote or a backslash."""
    safe = ~chain.rlike("[\"'\\\\]") & ~number.rlike("[\"'\\\\]")
    return F.when(safe, F.concat(F.lit("chain "), chain, F.lit(" and resi "), number))
