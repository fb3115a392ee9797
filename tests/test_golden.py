"""The pinned example from files to evidence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foldframe.operators import distances, evidence, interactions, msa, sites
from foldframe.operators.correspondence import explode_alignments, with_residues
from foldframe.sources import structures
from tests.golden import write


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    raw = structures.read(spark, write(tmp_path_factory.mktemp("golden")))
    residues, atoms = structures.residues(raw).filter("is_standard").cache(), structures.atoms(raw).cache()
    chains = structures.chains(residues)
    rows = msa.align(chains.select(F.lit("g").alias("alignment_id"), F.when(F.col("structure_id") == "reference", 0).otherwise(1).alias("seq_ord"), "structure_id", "sequence")).cache()
    strings = {r.structure_id: r.row for r in rows.collect()}
    pairs = spark.createDataFrame([("p", "reference", "target", strings["reference"], strings["target"])], "pair_id string, reference_id string, target_id string, aligned_reference string, aligned_target string")
    places = residues.join(atoms.filter("name = 'CA'").select("residue_key", "x", "y", "z"), "residue_key")
    mapping = with_residues(explode_alignments(pairs), places).cache()
    return {"raw": raw, "residues": residues, "atoms": atoms, "rows": rows, "mapping": mapping, "strings": strings}


def test_alignment_and_conservation(golden, spark):
    assert golden["strings"] == {"reference": "KDSGAF", "target": "KDVGA-"}
    cells = msa.cells(golden["rows"])
    labels = golden["residues"].filter("structure_id = 'reference'").select(F.lit("g").alias("alignment_id"), F.col("residue_ord").alias("seq_index"), F.concat(F.lit("A:"), "auth_seq_id").alias("label"), "residue_key")
    got = [(r.reference_label, r.non_gap_count, r.gap_fraction, r.conservation and round(r.conservation, 6), r.entropy_bits) for r in msa.columns(cells, labels).orderBy("column_index").collect()]
    assert got == [("A:1", 2, 0.0, 1.0, 0.0), ("A:2", 2, 0.0, 1.0, 0.0), ("A:3", 2, 0.0, 0.768622, 1.0), ("A:4", 2, 0.0, 1.0, 0.0), ("A:5", 2, 0.0, 1.0, 0.0), ("A:6", 1, 0.5, None, None)]


def test_contacts_and_differences(golden):
    own = golden["atoms"].join(golden["residues"].select("residue_key"), "residue_key")
    contacts = interactions.detect(own)
    got = sorted((r.structure_id, r.type, round(r.distance, 3)) for r in contacts.collect())
    hbonds = [1.414, 1.825, 2.283, 2.625]
    assert got == sorted([(s, "hbond_geometric", d) for s in ("reference", "target") for d in hbonds] + [("reference", "hydrophobic", 3.833)])
    mapping = golden["mapping"].filter("reference_key is not null and target_key is not null").select("pair_id", "reference_id", "target_id", F.col("reference_label").alias("position"), "reference_key", "target_key")
    got = sorted((r.pos_a, r.pos_b, r.type, r.change) for r in interactions.compare(contacts, mapping).collect())
    assert got == [(f"A:{i}", f"A:{i + 1}", "hbond_geometric", "conserved") for i in range(1, 5)]
    loose = interactions.compare(contacts, mapping, keep_unmapped_reference=True).filter("change = 'reference_only_unmapped'").collect()
    assert [(r.type, round(r.reference_distance, 3)) for r in loose] == [("hydrophobic", 3.833)]


def test_sites(golden, spark):
    reference = golden["residues"].filter("structure_id = 'reference'")
    keys = [r.residue_key for r in reference.orderBy("residue_ord").collect()]
    moved = golden["mapping"].withColumnsRenamed({f"target_{c}": f"moved_{c}" for c in "xyz"})
    key_sites = sites.members_by_keys(spark.createDataFrame([("key", keys[:3])], "site_id string, keys array<string>"), reference)
    own = golden["atoms"].filter("structure_id = 'reference'")
    chain = own.join(reference.select("residue_key"), "residue_key")
    ligand = sites.members_by_radius(own.filter("residue_name = 'LIG'").select(F.lit("lig").alias("site_id"), "structure_id", "x", "y", "z"), chain, 6.0)
    around = sites.members_by_radius(own.filter(F.col("residue_key") == keys[1]).select(F.lit("res").alias("site_id"), "structure_id", "x", "y", "z"), chain, 6.0)
    members = key_sites.unionByName(ligand).unionByName(around)
    got = {r.site_id: r for r in sites.metrics(members, moved, golden["atoms"]).collect()}
    key = got["key"]
    assert (key.mapped_count, key.coverage, round(key.global_rmsd, 6), round(key.site_fitted_rmsd, 6), round(key.charged_fraction, 6), key.polar_fraction, round(key.hull_volume, 5)) == (3, 1.0, 0.5, 0.0, 0.666667, 0.0, 12.73133)
    for name in ("lig", "res"):
        assert (got[name].mapped_count, got[name].charged_fraction, round(got[name].hull_volume, 5), got[name].sasa) == (4, 0.5, 21.63517, None)


def test_distances_and_evidence(golden):
    rows = golden["mapping"].withColumnsRenamed({"reference_ord": "position_ord", "reference_label": "position", "reference_position": "number"})
    half = distances.distance_difference(rows.filter("reference_key is not null"))
    got = {(r.pos_i, r.pos_j): round(r.delta, 6) for r in half.filter("valid").collect()}
    assert {k: v for k, v in got.items() if v} == {("A:1", "A:5"): 0.086549, ("A:2", "A:5"): 0.115098, ("A:4", "A:5"): 0.313971}
    assert half.filter("not valid").filter("d_ref is null and delta is null").count() == 5
    vectors = distances.displacement_vectors(rows.filter("reference_key is not null"), end="target").orderBy("rank").collect()
    assert [(v.position, round(v.magnitude, 6)) for v in vectors] == [("A:5", 1.3), ("A:1", 0.5), ("A:2", 0.5), ("A:3", 0.5), ("A:4", 0.5)]
    keys = golden["mapping"].filter("reference_ord = 0").select("pair_id", "target_id", "reference_key", "reference_name")
    sequence = keys.select("pair_id", "reference_key", F.lit("conserved").alias("kind"))
    card = evidence.cards(keys, sequence, keys.select("pair_id", "reference_key", F.lit(1.3).alias("d"))).first()
    assert (card.overall_status, card.source_count, card.available_sections, card.text) == ("partial", 2, ["sequence", "structure"], "Reference LYS · target target · evidence partial")
