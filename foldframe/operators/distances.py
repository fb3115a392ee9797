"""Distance-difference maps, displacement vectors and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldframe.operators.spatial import within
from foldframe.operators.superposition import distance, rmsd


def distance_difference(rows: DataFrame) -> DataFrame:
    """pair_id, pos_i, pos_j, d_ref, d_tgt, delta, valid for i < j of each pair's reference positions.

    rows: pair_id, position_ord, position, reference_x.., target_x.. (null where
    absent). A position without either side is invalid: null distances, valid
    false. The map is symmetric with a zero diagonal, so that half of it says all.
    """
    side = [f"{s}_{c}" for s in ("reference", "target") for c in "xyz"]
    own = rows.select("pair_id", "position_ord", "position", *side)
    a = own.select("pair_id", *[F.col(c).alias(f"i_{c}") for c in own.columns[1:]])
    b = own.select("pair_id", *[F.col(c).alias(f"j_{c}") for c in own.columns[1:]])
    met = a.join(b, "pair_id").filter("i_position_ord < j_position_ord")
    d_ref, d_tgt = distance("i_reference", "j_reference"), distance("i_target", "j_target")
    valid = d_ref.isNotNull() & d_tgt.isNotNull()
    out = met.select("pair_id", F.col("i_position").alias("pos_i"), F.col("j_position").alias("pos_j"), F.when(valid, d_ref).alias("d_ref"), F.when(valid, d_tgt).alias("d_tgt"), valid.alias("valid"))
    return out.withColumn("delta", F.col("d_tgt") - F.col("d_ref"))


def dense_map(half: DataFrame, field: str = "delta") -> DataFrame:
    """Both halves and the diagonal of a distance_difference as (pair_id, pos_i, pos_j, value)."""
    value = F.col(field).alias("value")
    mirror = half.select("pair_id", F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), value)
    ends = half.select("pair_id", F.explode(F.array("pos_i", "pos_j")).alias("pos_i")).distinct()
    return half.select("pair_id", "pos_i", "pos_j", value).unionByName(mirror).unionByName(ends.select("pair_id", "pos_i", F.col("pos_i").alias("pos_j"), F.lit(0.0).alias("value")))


def displacement_vectors(rows: DataFrame, least: float = 0.5, most: int = 100, end: str = "moved") -> DataFrame:
    """The `most` longest vectors of each pair, of magnitude `least` at least, by falling magnitude, then position as text."""
    parts = [(F.col(f"{end}_{c}") - F.col(f"reference_{c}")).alias(f"v{c}") for c in "xyz"]
    long = rows.select("pair_id", "position", "reference_key", "target_key", *[F.col(f"reference_{c}").alias(f"s{c}") for c in "xyz"], *[F.col(f"{end}_{c}").alias(f"e{c}") for c in "xyz"], *parts, distance("reference", end).alias("magnitude"))
    ranked = long.filter(F.col("magnitude") >= least).withColumn("rank", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("magnitude"), "position")))
    return ranked.filter(F.col("rank") <= most)


def neighbourhoods(residues: DataFrame, radius: float = 5.0) -> DataFrame:
    """structure_id, center, member, distance: residues whose C-alpha lies within radius of another's, itself included."""
    own = residues.select("structure_id", "residue_key", "x", "y", "z")
    return within(own, own, radius, ["structure_id"]).select("structure_id", F.col("left_residue_key").alias("center"), F.col("right_residue_key").alias("member"), "distance")


def local_rmsd(moved_rows: DataFrame, members: DataFrame) -> DataFrame:
    """pair_id, center, local_rmsd, n: RMSD of the pair's displacement over each reference neighbourhood, without a fit of its own."""
    own = moved_rows.filter("ca_displacement is not null").select("pair_id", F.col("reference_key").alias("member"), "ca_displacement")
    met = members.select("center", "member").join(own, "member")
    return met.groupBy("pair_id", "center").agg(rmsd(F.col("ca_displacement")).alias("local_rmsd"), F.count(F.lit(1)).alias("n"))
