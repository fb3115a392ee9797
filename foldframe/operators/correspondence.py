"""Residue correspondence: the fact table that every other result joins to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldframe.functions.lookups import is_canonical, substitution_table

#: What a side's residue fields are called in correspondence rows.
RESIDUE_FIELDS = ("key", "label", "name", "num")


def status(reference: Column, target: Column) -> Column:
    """insertion, deletion, nonstandard, conserved or substitution, in that precedence; a gap is '-'."""
    return (
        F.when(reference == "-", "insertion")
        .when(target == "-", "deletion")
        .when(~(is_canonical(reference) & is_canonical(target)), "nonstandard")
        .when(reference == target, "conserved")
        .otherwise("substitution")
    )


def explode_alignments(alignments: DataFrame) -> DataFrame:
    """(pair_id, reference_id, target_id, aligned_reference, aligned_target) -> a row for each column.

    Adds alignment_index, reference_aa, target_aa (null at gaps), reference_ord,
    target_ord (numbers in the chains, null at gaps) and status. '.' counts as '-'.
    Strings of unequal length are an error.
    """
    clean = lambda c: F.upper(F.translate(c, ".", "-"))
    both = alignments.withColumns({"_r": clean("aligned_reference"), "_t": clean("aligned_target")})
    same = F.assert_true(F.length("_r") == F.length("_t"), F.lit("aligned strings differ in length"))
    cells = F.arrays_zip(F.split("_r", "").alias("r"), F.split("_t", "").alias("t"))
    rows = both.filter(same.isNull() & (F.length("_r") > 0)).select("pair_id", "reference_id", "target_id", F.posexplode(cells).alias("alignment_index", "c"))
    rows = rows.select("pair_id", "reference_id", "target_id", "alignment_index", F.col("c.r").alias("r"), F.col("c.t").alias("t"))
    run = Window.partitionBy("pair_id").orderBy("alignment_index").rowsBetween(Window.unboundedPreceding, 0)
    nth = lambda c: F.when(F.col(c) != "-", F.sum(F.when(F.col(c) != "-", 1).otherwise(0)).over(run).cast("int") - 1)
    return rows.select(
        "pair_id", "reference_id", "target_id", "alignment_index",
        F.when(F.col("r") != "-", F.col("r")).alias("reference_aa"), F.when(F.col("t") != "-", F.col("t")).alias("target_aa"),
        nth("r").alias("reference_ord"), nth("t").alias("target_ord"), status(F.col("r"), F.col("t")).alias("status"),
    )


def with_residues(rows: DataFrame, residues: DataFrame) -> DataFrame:
    """Adds reference_* and target_* fields of the residues (structure_id, residue_ord, residue_key, chain_id, auth_seq_id, insertion_code, residue_name, x, y, z)."""
    number = F.concat("auth_seq_id", F.coalesce("insertion_code", F.lit("")))
    own = residues.select(
        "structure_id", F.col("residue_ord").alias("ord"), F.col("residue_key").alias("key"), number.alias("num"), F.concat("chain_id", F.lit(":"), number).alias("label"),
        F.col("residue_name").alias("name"), F.col("auth_seq_id").try_cast("int").alias("position"), "x", "y", "z",
    )
    for side in ("reference", "target"):
        named = own.select(*[F.col(c).alias(f"{side}_id" if c == "structure_id" else f"{side}_{c}") for c in own.columns])
        rows = rows.join(named, [f"{side}_id", f"{side}_ord"], "left")
    return rows


def with_scores(rows: DataFrame) -> DataFrame:
    """Adds sequence_score of mapped columns by the matrix of 24 symbols."""
    table = substitution_table(rows.sparkSession).select("reference_aa", "target_aa", F.col("score").alias("sequence_score"))
    return rows.join(F.broadcast(table), ["reference_aa", "target_aa"], "left")


def sequence_metrics(rows: DataFrame) -> DataFrame:
    """identity, similarity, coverage, target_coverage, aligned_count of each pair; 0.0 on an empty denominator."""
    scored = rows if "sequence_score" in rows.columns else with_scores(rows)
    r, t = is_canonical(F.col("reference_aa")), is_canonical(F.col("target_aa"))
    counts = scored.groupBy("pair_id", "reference_id", "target_id").agg(
        F.count_if(r & t).alias("aligned_count"), F.count_if(r & t & (F.col("reference_aa") == F.col("target_aa"))).alias("_same"),
        F.count_if(r & t & (F.col("sequence_score") > 0)).alias("_like"), F.count_if(r).alias("_r"), F.count_if(t).alias("_t"),
    )
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return counts.select(
        "pair_id", "reference_id", "target_id", ratio("_same", "aligned_count").alias("identity"), ratio("_like", "aligned_count").alias("similarity"),
        ratio("aligned_count", "_r").alias("coverage"), ratio("aligned_count", "_t").alias("target_coverage"), "aligned_count",
    )


def decision(metrics: DataFrame, mode: str = "auto", min_identity: float = 0.30, min_coverage: float = 0.70) -> DataFrame:
    """Adds mapping_mode (sequence, structure or manual) and the decision's text. auto: by sequence if both thresholds are reached."""
    i, c = F.bround("identity", 3), F.bround("coverage", 3)
    enough = (F.col("identity") >= min_identity) & (F.col("coverage") >= min_coverage)
    # The wording of each decision.
    said = {
        "sequence": F.format_string("sequence-guided (explicit mode; identity=%.3f, coverage=%.3f)", i, c),
        "manual": F.lit("manual (explicit correspondences required)"),
        "structure": F.lit("structure-guided (explicit mode)"),
        "auto": F.when(enough, F.format_string(f"sequence-guided (AUTO: identity=%.3f >= {min_identity:.3f}, coverage=%.3f >= {min_coverage:.3f})", i, c)).otherwise(
            F.format_string("structure-guided (AUTO: identity=%.3f or coverage=%.3f below thresholds)", i, c)
        ),
    }
    chosen = F.when(enough, "sequence").otherwise("structure") if mode == "auto" else F.lit(mode)
    return metrics.withColumns({"mapping_mode": chosen, "decision": said[mode]})


def counts(rows: DataFrame) -> DataFrame:
    """mutation_count (any status but conserved), insertion_count, deletion_count, conserved_count, unmapped rows left out."""
    own = rows.filter("status <> 'unmapped'")
    number = lambda c: F.count_if(c)
    return own.groupBy("pair_id").agg(
        number(F.col("status") != "conserved").alias("mutation_count"), number(F.col("status") == "insertion").alias("insertion_count"),
        number(F.col("status") == "deletion").alias("deletion_count"), number(F.col("status") == "conserved").alias("conserved_count"),
    )


def manual_mapping(pairs: DataFrame, residues: DataFrame) -> DataFrame:
    """Locked rows of named residue pairs (pair_id, reference_id, target_id, pair_ord, reference_token, target_token; token chain:number).

    alignment_index is the order of the pair. A token without a residue is an error.
    """
    token = F.concat("chain_id", F.lit(":"), "auth_seq_id", F.coalesce("insertion_code", F.lit("")))
    own = residues.select("structure_id", token.alias("token"), "residue_key", F.coalesce("one_letter", F.lit("X")).alias("aa"))
    rows = pairs
    for side in ("reference", "target"):
        named = own.select(F.col("structure_id").alias(f"{side}_id"), F.col("token").alias(f"{side}_token"), F.col("residue_key").alias(f"{side}_key"), F.col("aa").alias(f"{side}_aa"))
        rows = rows.join(named, [f"{side}_id", f"{side}_token"], "left")
    found = F.assert_true(F.col("reference_key").isNotNull() & F.col("target_key").isNotNull(), F.concat(F.lit("no such residue in pair "), F.col("pair_id")))
    return rows.filter(found.isNull()).select(
        "pair_id", "reference_id", "target_id", F.col("pair_ord").alias("alignment_index"), "reference_key", "target_key", "reference_aa", "target_aa",
        status(F.col("reference_aa"), F.col("target_aa")).alias("status"), F.lit("manual").alias("mapping_source"), F.lit(True).alias("mapping_locked"),
    )


def from_report(rows: DataFrame) -> DataFrame:
    """explode_alignments of a structural alignment report's strings with its own statuses: letters alike or not, never nonstandard."""
    same = F.when(F.col("reference_aa") == F.col("target_aa"), "conserved").otherwise("substitution")
    return explode_alignments(rows).withColumns({"status": F.when(F.col("status").isin("insertion", "deletion"), F.col("status")).otherwise(same), "mapping_source": F.lit("structure")})


def validate(rows: DataFrame, outlier_cutoff: float = 2.0, strict: bool = False) -> DataFrame:
    """Adds is_duplicate (a residue that stands in several unlocked rows of its pair; strict: an error) and is_outlier (ca_displacement beyond the cutoff, false if unknown)."""
    locked = F.coalesce(F.col("mapping_locked"), F.lit(False)) if "mapping_locked" in rows.columns else F.lit(False)
    twice = lambda key: F.col(key).isNotNull() & ~locked & (F.count_if(~locked).over(Window.partitionBy("pair_id", key)) > 1)
    out = rows.withColumns(
        {"is_duplicate": twice("reference_key") | twice("target_key"), "is_outlier": F.coalesce(F.col("ca_displacement") > outlier_cutoff, F.lit(False))}
    )
    return out.filter(F.assert_true(~F.col("is_duplicate"), F.concat(F.lit("a residue stands twice in pair "), F.col("pair_id"))).isNull()) if strict else out


#: Predicates of correspondence rows by name.
HIGHLIGHTS = {
    "all": "true",
    "mutations": "status not in ('conserved', 'unmapped')",
    "conserved": "status = 'conserved'",
    "key": "is_key",
    "mutated_key": "is_key and status <> 'conserved'",
    "outliers": "is_outlier",
    "insertions_deletions": "status in ('insertion', 'deletion')",
    "displacement": "ca_displacement is not null",
}


def highlight(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.expr(HIGHLIGHTS[name]))
