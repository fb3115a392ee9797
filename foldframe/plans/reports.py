"""The sheets of a workbook, each a table, put together from an analysis; nothing is measured anew here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.operators import correspondence, distances, evidence, interactions, msa, sites
from foldframe.plans import derived, registry
from foldframe.plans.engine import Analysis
from foldframe.plans.registry import _around, _key_members, _mapping, _msa_cells, _msa_labels, _q, _rounded, query
from foldframe.sources import sinks


def summary_sheet(summary: DataFrame) -> DataFrame:
    """pair_id, metric, value, text, unit: a row for each figure of a pair; the decision is text."""
    number = lambda name, c, unit: F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("text"), F.lit(unit).alias("unit"))
    rows = [
        number("Sequence identity", "identity", "fraction"), number("Sequence coverage", "coverage", "fraction"), number("Strict Cα RMSD", "strict_rmsd", "Å"), number("Refined Cα RMSD", "refined_rmsd", "Å"),
        number("Mapped residues", "mapped_count", "residues"), number("Mutation count", "mutation_count", "events"), F.struct(F.lit("Alignment decision").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("decision").alias("text"), F.lit("").alias("unit")),
    ]
    return summary.select("pair_id", F.inline(F.array(*rows)))


def pair_sheets(a: Analysis, key_residues: DataFrame | None = None, refined: bool = False) -> dict[str, DataFrame]:
    """Summary, Residues and Mutations. key_residues: reference_key."""
    mutations = a.mutations()
    rows = correspondence.validate(a.residue_metrics() if a.atoms is not None else a.moved())
    return {"Summary": summary_sheet(a.summary(refined=refined)), "Residues": sinks.residue_sheet(rows, mutations, key_residues), "Mutations": mutations}


def quality_sheet(cards: DataFrame) -> DataFrame:
    """What each card has and lacks."""
    joined = lambda c: F.array_join(c, ", ")
    return cards.select("pair_id", "reference_key", "target_id", "overall_status", joined("available_sections").alias("available_sections"), joined("unavailable_sections").alias("unavailable_sections"))


def differences_sheet(differences: DataFrame) -> DataFrame:
    """Differences with the evidence behind their type."""
    mode = F.when(F.col("type") == "pi_stacking", "aromatic_ring_geometry").when(F.col("type") == "cation_pi", "cation_ring_geometry").otherwise("heavy_atom_geometry")
    return differences.select("pair_id", "type", "pos_a", "pos_b", "change", "reference_distance", "target_distance", mode.alias("evidence_mode"))


def study_sheets(a: Analysis, cells: DataFrame, labels: DataFrame, members: DataFrame, cards: DataFrame, sources: list[str]) -> dict[str, DataFrame]:
    """The sheets of a whole study: alignment, interactions, sites, distances, evidence and provenance.

    cells and labels: see operators.msa; members: site_id, structure_id,
    residue_key of reference residues; cards: see operators.evidence.
    """
    columns, mapping = msa.columns(cells, labels), _mapping(a)
    named = msa.column_labels(cells, labels).select("alignment_id", "column_index", "reference_label")
    differences = interactions.compare(interactions.detect(a.atoms), mapping)
    metrics = sites.metrics(members, a.moved(), a.atoms)
    touched = members.select("site_id", F.col("residue_key").alias("reference_key")).join(mapping.select("pair_id", "reference_key", "position"), "reference_key").select("site_id", "pair_id", "position")
    rows = a.correspondence().filter("reference_key is not null").withColumnsRenamed({"reference_ord": "position_ord", "reference_label": "position", "reference_position": "number"})
    return {
        "MSA": columns,
        "Conservation": columns.select("alignment_id", "column_index", "reference_label", "conservation", "gap_fraction", "ambiguous_fraction", F.lit("fraction").alias("unit")),
        "Amino Acid Frequencies": msa.frequency_sheet(cells).join(named, ["alignment_id", "column_index"]),
        "Insertions": msa.insertions(cells, named),
        "Interaction Differences": differences_sheet(differences),
        "Sites": metrics.select("site_id", "pair_id", "target_id", "mapped_count", "coverage", "global_rmsd", "site_fitted_rmsd", "sasa", "hull_volume"),
        "Site Metrics": metrics.select("site_id", "pair_id", "target_id", "centroid_displacement", "rg", "polar_fraction", "charged_fraction"),
        "Site Interaction Fingerprints": interactions.fingerprint(differences, touched),
        "Distance Difference Matrix": distances.distance_difference(rows),
        "Residue Evidence": cards.select("pair_id", "reference_key", "target_id", "overall_status", "text"),
        "Evidence Quality": quality_sheet(cards),
        "Provenance": cells.sparkSession.createDataFrame([(s,) for s in sources], "source string"),
    }


# ---- Queries -------------------------------------------------------------------------------------


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = registry._analysis(spark, sf_dir)
    own = a.moved().filter("reference_key is not null").select("pair_id", "alignment_index", "reference_key", "target_id", "reference_name", "ca_displacement")
    sequence = own.join(a.mutations().select("pair_id", "alignment_index", "kind", "notation"), ["pair_id", "alignment_index"]).select("pair_id", "reference_key", "kind", "notation")
    site = own.join(_key_members(spark, sf_dir).select("site_id", F.col("residue_key").alias("reference_key")), "reference_key").select("pair_id", "reference_key", "site_id")
    return evidence.cards(own.select("pair_id", "target_id", "reference_key", "reference_name"), sequence, own.filter("ca_displacement is not null").select("pair_id", "reference_key", "ca_displacement"), None, site)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_members(spark, sf_dir).select(F.col("residue_key").alias("reference_key"))


def _study(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return study_sheets(registry._analysis(spark, sf_dir).kept(atoms=False), _msa_cells(spark, sf_dir), _msa_labels(spark, sf_dir), _around(spark, sf_dir, "radius"), _cards(spark, sf_dir), [f"{sf_dir.rpartition('/')[2]}/embeddings"])


_FIGURES = [("Sequence identity", "identity", "fraction"), ("Sequence coverage", "coverage", "fraction"), ("Strict Cα RMSD", "strict_rmsd", "Å"), ("Refined Cα RMSD", "CAST(NULL AS DOUBLE)", "Å"), ("Mapped residues", "CAST(mapped_count AS DOUBLE)", "residues"), ("Mutation count", "CAST(mutation_count AS DOUBLE)", "events")]
_SUMMARY_SHEET = " UNION ALL ".join(f"SELECT pair_id, '{name}' AS metric, round({c}, 4) + 0.0 AS value, CAST(NULL AS VARCHAR) AS text, '{unit}' AS unit FROM s" for name, c, unit in _FIGURES)


@query(f", s AS ({registry._SUMMARY}) {_SUMMARY_SHEET} UNION ALL SELECT pair_id, 'Alignment decision', NULL, decision, '' FROM ({registry._DECISION})")
def sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary_sheet(registry._analysis(spark, sf_dir).summary()))


@query(f"""{registry._KEY_SITES} {registry._RESIDUE_RMSD_TABLES}, rr AS ({registry._RESIDUE_RMSD})
SELECT mov.pair_id, mov.alignment_index, CASE WHEN mov.reference_key IS NOT NULL THEN 'A:' || mov.rnum || ' ' || mov.rname END AS reference, CASE WHEN mov.target_key IS NOT NULL THEN 'A:' || mov.tnum || ' ' || mov.tname END AS target, mov.status, ev.notation,
  {_q('CASE WHEN mapped THEN ca_displacement END AS ca_displacement')}, backbone_rmsd, sidechain_rmsd, all_heavy_rmsd, coalesce(mapped AND ca_displacement > 2.0, false) AS is_outlier, ks.residue_key IS NOT NULL AS is_key
FROM mov LEFT JOIN (SELECT * FROM ev WHERE kind <> 'conserved') ev USING (pair_id, alignment_index) LEFT JOIN rr USING (pair_id, alignment_index) LEFT JOIN ks ON ks.residue_key = mov.reference_key""")
def sheet_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pair_sheets(registry._analysis(spark, sf_dir), _keys(spark, sf_dir))["Residues"])


@query(f"""{registry._KEY_SITES}, cd AS (SELECT pair_id, reference_key, target_id, [CASE WHEN c.kind IS NOT NULL THEN 'sequence' END, CASE WHEN ca_displacement IS NOT NULL THEN 'structure' END, CASE WHEN ks.site_id IS NOT NULL THEN 'site' END] AS has
  FROM mov JOIN ev c USING (pair_id, alignment_index) LEFT JOIN ks ON ks.residue_key = reference_key WHERE reference_key IS NOT NULL)
SELECT pair_id, reference_key, target_id, CASE WHEN len(list_filter(has, lambda x: x IS NOT NULL)) = 0 THEN 'unavailable' ELSE 'partial' END AS overall_status, array_to_string(list_filter(has, lambda x: x IS NOT NULL), ', ') AS available_sections,
  array_to_string(list_filter(['sequence', 'structure', 'interactions', 'site'], lambda s: NOT list_contains(has, s)), ', ') AS unavailable_sections FROM cd""")
def sheet_evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir)["Evidence Quality"]


@query(f"""{registry._DIFF} SELECT pair_id, type, pos_a, pos_b, change, {_q('reference_distance', 'target_distance')}, CASE type WHEN 'pi_stacking' THEN 'aromatic_ring_geometry' WHEN 'cation_pi' THEN 'cation_ring_geometry' ELSE 'heavy_atom_geometry' END AS evidence_mode FROM diff""")
def sheet_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_study(spark, sf_dir)["Interaction Differences"])


@query(f"{registry._MSA} SELECT alignment_id, column_index, reference_label, {_q('1.0 - entropy_bits / log2(20) AS conservation', 'gap_fraction', 'ambiguous_fraction')}, 'fraction' AS unit FROM mlab JOIN mcon USING (alignment_id, column_index)")
def sheet_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_study(spark, sf_dir)["Conservation"])
