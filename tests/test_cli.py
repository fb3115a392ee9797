from __future__ import annotations

import json
import math

import numpy as np

from foldframe.__main__ import main
from foldframe.operators import surface
from foldframe.operators.correspondence import from_report
from tests.golden import write


def test_compare(spark, tmp_path, capsys):
    paths = write(tmp_path)
    assert main(["compare", *paths, "--output", str(tmp_path / "o.xlsx"), "--csv", str(tmp_path / "c"), "--json", str(tmp_path / "j.json")]) == 0
    out = capsys.readouterr().out
    assert "Reference: reference" in out and "Mapped residues: 5" in out and "sequence-guided (AUTO: identity=0.800 >= 0.300, coverage=0.833 >= 0.700)" in out
    assert json.loads((tmp_path / "j.json").read_text())["aligned_count"] == 5
    assert main(["compare", paths[0], paths[0]]) == 0
    assert "Strict Cα RMSD: 0.000 Å" in capsys.readouterr().out
    assert main(["compare", *paths, "--mode", "manual"]) == 2
    assert main(["compare", paths[0], str(tmp_path / "none.pdb")]) == 2


def test_report_statuses(spark):
    rows = spark.createDataFrame([("p", "r", "t", "AX-D", "AXGE")], "pair_id string, reference_id string, target_id string, aligned_reference string, aligned_target string")
    assert [r.status for r in from_report(rows).orderBy("alignment_index").collect()] == ["conserved", "conserved", "insertion", "substitution"]


def test_surface(spark):
    r = surface.RADII["C"] + surface.PROBE
    one = surface.accessible(np.zeros((1, 3)), np.array([surface.RADII["C"]]))
    assert math.isclose(one[0], 4 * math.pi * r * r)
    # Two spheres at a distance d hide a cap each.
    d = 2.0
    two = surface.accessible(np.array([[0, 0, 0], [d, 0, 0]], float), np.full(2, surface.RADII["C"]))
    assert np.allclose(two, 4 * math.pi * r * r - 2 * math.pi * r * (r - d / 2), rtol=0.02)
    atoms = spark.createDataFrame([("s", "a", "C", 0.0, 0.0, 0.0), ("s", "b", "C", d, 0.0, 0.0), ("u", "c", "C", None, 0.0, 0.0)], "structure_id string, residue_key string, element string, x double, y double, z double")
    assert {row.residue_key: round(row.sasa, 3) for row in surface.sasa(atoms).collect()} == {"a": round(two[0], 3), "b": round(two[1], 3)}
