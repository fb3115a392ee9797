"""Files in and out."""

from __future__ import annotations

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foldframe.sources import sequences, sinks, structures
from foldframe.streaming.structures import append_residues
from tests.golden import LIGAND, REFERENCE, pdb

ALTERNATES = """\
ATOM      1  N   ALA A  57      -3.500   4.250   8.125  1.00 31.50           N
ATOM      2  CA AALA A  57      -2.750   3.500   7.000  0.45 31.50           C
ATOM      3  CA BALA A  57      -2.250   3.750   6.500  0.55 31.50           C
ATOM      4  CA  GLY A  57A      1.500   2.500   5.750  1.00 31.50           C
HETATM    5  CA  MSE A  58       4.875   1.250   4.500  1.00 31.50          SE
HETATM    6  O   HOH A  59       9.000  -6.500   0.750  1.00 31.50           O
END
"""
FIELDS = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy auth_seq_id auth_asym_id pdbx_PDB_model_num"
MMCIF = (
    "data_x\n#\n_cell.note\n;a loop_ in text\n;\nloop_\n"
    + "".join(f"_atom_site.{f}\n" for f in FIELDS.split())
    + "ATOM 1 C CA . ALA A 42 ? 1.0 2.0 3.0 1.00 100 A 1\nATOM 2 C \"C'\" . GLY A 43 A 4.0 5.0 6.0 1.00 100 A 1\n#\nloop_\n_other.a\n1 2\n"
)


def test_pdb(spark, tmp_path):
    (tmp_path / "one.pdb").write_text(ALTERNATES)
    (tmp_path / "Two.ENT.gz").write_bytes(gzip.compress(ALTERNATES.encode()))
    raw = structures.read(spark, [str(tmp_path / "one.pdb"), str(tmp_path / "Two.ENT.gz")])
    for name in ("one", "Two"):
        own = raw.filter(F.col("structure_id") == name)
        got = [(r.auth_seq_id, r.insertion_code, r.residue_name, r.one_letter, r.residue_ord) for r in structures.residues(own).orderBy("residue_ord").collect()]
        assert got == [("57", None, "ALA", "A", 0), ("57", "A", "GLY", "G", 1), ("58", None, "MSE", None, 2)]
        assert [(r.x, r.altloc) for r in structures.atoms(own).filter("name = 'CA' and residue_ord = 0").collect()] == [(-2.25, "B")]
        assert structures.chains(structures.residues(own)).first().sequence == "AGX"
    (tmp_path / "bad.txt").write_text("x")
    with pytest.raises(Exception, match="not a structure file"):
        structures.read(spark, str(tmp_path / "bad.txt")).collect()
    assert structures.with_hashes(spark, str(tmp_path / "one.pdb")).first().sha256 == __import__("hashlib").sha256(ALTERNATES.encode()).hexdigest()


def test_models_and_chains(spark, tmp_path):
    line = "ATOM      1  CA  ALA {c}   1      10.000  10.000  10.000  1.00 20.00           C"
    (tmp_path / "m.pdb").write_text("MODEL        1\n" + line.format(c="B") + "\n" + line.format(c="A") + "\nENDMDL\nMODEL        2\n" + line.format(c="A") + "\nENDMDL\n")
    chains = structures.chains(structures.residues(structures.read(spark, str(tmp_path / "m.pdb"))))
    assert [(r.model_id, r.chain_id) for r in chains.orderBy("chain_ord").collect()] == [("0", "B"), ("0", "A"), ("1", "A")]
    assert [r.chain_id for r in structures.select_chain(chains).collect()] == ["B"]
    assert structures.select_chain(chains, "A").count() == 2


def test_mmcif(spark, tmp_path):
    (tmp_path / "n.cif").write_text(MMCIF)
    raw = structures.read(spark, str(tmp_path / "n.cif")).orderBy("line").collect()
    assert [(r.auth_seq_id, r.insertion_code, r.label_seq_id, r.name, r.altloc, r.x) for r in raw] == [("100", None, "42", "CA", None, 1.0), ("100", "A", "43", "C'", None, 4.0)]


def test_fasta(spark, tmp_path):
    (tmp_path / "s.fasta").write_text(">one first > of all\nac\nDE\n\n>two\r\nATDE\r\n")
    got = [(r.identifier, r.description, r.sequence) for r in sequences.read_fasta(spark, str(tmp_path / "s.fasta")).orderBy("seq_ord").collect()]
    assert got == [("one", "one first > of all", "ACDE"), ("two", "two", "ATDE")]


def test_report(spark):
    text = "US-align (Version 20230607)\nName of Structure_1: a.pdb\nName of Structure_2: b.pdb\nTM-score= 0.73120 (by 1)\nTM-score= 0.66040 (by 2)\nMK-W\n:. :\nMRLW\n i t u\n 0      4.5     0.0    -1.0     0.0\n 1     -0.5     1.0     0.0     0.0\n 2      2.25    0.0     0.0     1.0\n"
    r = sequences.parse_report(spark.createDataFrame([("p", text), ("q", "nothing")], "path string, content string")).orderBy("path").collect()
    assert (r[0].version, r[0].name_1, r[0].name_2, r[0].tm_score, r[0].aligned_reference, r[0].aligned_target) == ("20230607", "a.pdb", "b.pdb", 0.7312, "MK-W", "MRLW")
    assert r[0].rotation == [0, -1, 0, 1, 0, 0, 0, 0, 1] and r[0].translation == [4.5, -0.5, 2.25]
    assert r[1][1:] == (None,) * 8


def test_manual_text_and_projects(spark):
    df = spark.createDataFrame([("p", "# all\nA:1 -> B:2A\nA:3=B:4  # more\n\nA:5, B:-6")], "pair_id string, content string")
    assert [(r.reference_token, r.target_token) for r in sequences.parse_manual_pairs(df).orderBy("pair_ord").collect()] == [("A:1", "B:2A"), ("A:3", "B:4"), ("A:5", "B:-6")]
    with pytest.raises(Exception, match="not a pair"):
        sequences.parse_manual_pairs(df.withColumn("content", F.lit("A1 B2"))).collect()
    texts = spark.createDataFrame([("a", json.dumps({"version": "3.0", "reference_id": "r", "targets": ["t"]}))], "path string, content string")
    projects = sequences.with_key_residue(sequences.with_key_residue(sequences.parse_projects(texts), "r/A/1"), "r/A/1")
    row = projects.first()
    assert (row.targets, row.key_residues, row.settings) == (["t"], ["r/A/1"], {})
    assert json.loads(sinks.as_json(projects.drop("path")).first().value)["analyses"] is None
    with pytest.raises(Exception, match="unsupported"):
        sequences.parse_projects(texts.withColumn("content", F.lit('{"version": "9"}'))).collect()
    old = spark.createDataFrame([("t", "1"), ("u", "2")], "target_id string, payload string")
    assert sorted(r[:] for r in sequences.upsert_analysis(old, old.filter("target_id = 't'").withColumn("payload", F.lit("new"))).collect()) == [("t", "new"), ("u", "2")]


def test_workbook_csv_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1, 0.5), (None, None, None)], "name string, n int, x double")
    sinks.write_workbook({"One": df, "Two": df.limit(0)}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "a&lt;b" in sheet and "<c><v>0.5</v></c>" in sheet and "<row><c/><c/><c/></row>" in sheet and "autoFilter" in sheet
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["name", "n", "x"]
    sinks.write_sheets({"One": df}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/One")).count() == 2
    for name in ("x.zip", "y.zip"):
        sinks.write_bundle({"residues": df}, str(tmp_path / name), "r", "many", ["t"])
    assert (tmp_path / "x.zip").read_bytes() == (tmp_path / "y.zip").read_bytes()
    good = {n: zipfile.ZipFile(tmp_path / "x.zip").read(n) for n in ("manifest.json", "residues.json")}
    for name, data, said in (("../x", b"", "leaves"), ("run.exe", b"", "run"), ("manifest.json", b"{}", "lacks"), ("manifest.json", good["manifest.json"].replace(b'"1.0"', b'"2.0"'), "newer")):
        (tmp_path / "bad.zip").write_bytes(sinks._zipped({**good, name: data}))
        with pytest.raises(ValueError, match=said):
            sinks.validate_bundle(str(tmp_path / "bad.zip"))


def test_long_tables_reach_workbook_and_bundle_whole(spark, tmp_path, monkeypatch):
    df = spark.range(100_001).select("id")
    sinks.write_bundle({"residues": df}, str(tmp_path / "b.zip"), "r", "many", ["t"])
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        assert [r["id"] for r in json.loads(z.read("residues.json"))] == list(range(100_001))
    monkeypatch.setattr(sinks, "SHEET_ROWS", 60_000, raising=False)
    sinks.write_workbook({"One": df}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert 'name="One (2)"' in z.read("xl/workbook.xml").decode()
        assert [z.read(f"xl/worksheets/sheet{i}.xml").count(b"<row>") for i in (1, 2)] == [60_001, 40_002]


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"s{i}.pdb").write_text(pdb(REFERENCE, LIGAND["reference"]))
    for _ in range(2):
        append_residues(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("structure_id").count().collect()
    assert sorted(r[:] for r in got) == [(f"s{i}", 7) for i in range(3)]
