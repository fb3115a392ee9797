"""Queries that write the derived structures as files into the shared folder, read them back, and their SQL.

Files hold what readers must cope with: alternate locations, water, a second
model, ligands, quoted names, packed files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.operators import charts, correspondence, msa
from foldframe.plans import derived, registry
from foldframe.plans.registry import _analysis, _q, _r, _rounded, _structures, query
from foldframe.sources import sequences, sinks, structures
from foldframe.sources.shared import shared_dir, write_files
from foldframe.streaming.structures import append_residues


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """One folder for each input and kind: what is written again takes the place of what was there."""
    return f"{shared_dir(spark)}/files-{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}/{name}"


def _vid(c: str = "structure_id") -> Column:
    return F.substring(c, 2, 20).cast("bigint")


def _file_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms with what a file says of them: a second place for some, water, and a ligand in a second model."""
    own = derived.atoms(spark, sf_dir).withColumn("num", F.when(F.col("residue_ord") < 100, F.split("residue_key", "/")[2]).otherwise(F.col("residue_ord").cast("string")))
    own = own.withColumns({"auth": F.regexp_extract("num", "^[0-9]+", 0), "icode": F.regexp_extract("num", "[A-Z]$", 0), "model": F.lit(0)})
    two = (F.col("name") == "CB") & (_vid() % 3 < 2)
    place = lambda alt, more, occupancy: F.struct(F.lit(alt).alias("alt"), F.lit(more).alias("more"), occupancy.alias("occ"))
    first = F.when(_vid() % 3 == 0, 0.6).otherwise(0.4)
    own = own.withColumn("p", F.explode(F.when(two, F.array(place("A", 0.0, first), place("B", 0.5, 1 - first))).otherwise(F.array(place("", 0.0, F.lit(1.0))))))
    ligand = own.filter((_vid() % 5 == 0) & (F.col("residue_name") == "LIG"))
    water = own.filter("residue_name = 'LIG'").withColumns({"residue_name": F.lit("HOH"), "name": F.lit("O"), "element": F.lit("O"), "auth": F.lit("300"), "residue_ord": F.lit(102)})
    rows = own.unionByName(water).unionByName(ligand.withColumn("model", F.lit(1)))
    return rows.withColumns({c: F.round(F.col(c) + F.col("p.more"), 3) for c in "xyz"}).withColumns({"alt": F.col("p.alt"), "occ": F.col("p.occ"), "hetero": F.col("residue_ord") >= 100}).drop("p")


def _joined(rows: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda s: s["line"])
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("content"))


_ORDER = ["model", "residue_ord", "atom_ord", "alt"]


def _pdb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, content: a PDB file for each structure; every fifth has two models."""
    rows = _file_atoms(spark, sf_dir)
    record = F.when(F.col("hetero"), "HETATM").otherwise("ATOM")
    line = F.format_string("%-6s%5d %-4s%1s%3s A%4s%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", record, F.col("atom_ord"), "name", F.rpad("alt", 1, " "), "residue_name", "auth", F.rpad("icode", 1, " "), "x", "y", "z", "occ", F.lit(0.0), "element")
    rows = rows.select("structure_id", *_ORDER, line.alias("line"))
    models = rows.filter(_vid() % 5 == 0).select("structure_id", "model").distinct().select("structure_id", "model", F.lit(-1).alias("residue_ord"), F.lit(-1).alias("atom_ord"), F.lit("").alias("alt"), F.format_string("MODEL     %4d", F.col("model") + 1).alias("line"))
    return _joined(rows.unionByName(models), "structure_id", _ORDER, F.col("line")).select(F.concat("structure_id", F.lit(".pdb")).alias("name"), F.concat(F.lit("HEADER    MADE\n"), "content", F.lit("\nEND\n")).alias("content"))


_COLUMNS = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy auth_seq_id auth_asym_id pdbx_PDB_model_num"


def _mmcif_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, content: an mmCIF file for each structure, every second one packed; some names are quoted."""
    rows = _file_atoms(spark, sf_dir)
    blank = lambda c: F.when(F.col(c) == "", "?").otherwise(F.col(c))
    name = F.when(F.col("atom_ord") % 2 == 1, F.concat(F.lit('"'), "name", F.lit('"'))).otherwise(F.col("name"))
    label = F.when(F.col("hetero"), ".").otherwise((F.col("residue_ord") + 1).cast("string"))
    parts = [F.when(F.col("hetero"), "HETATM").otherwise("ATOM"), F.col("atom_ord").cast("string"), F.col("element"), name, F.when(F.col("alt") == "", ".").otherwise(F.col("alt")), F.col("residue_name"), F.lit("Z"), label, blank("icode")]
    parts += [F.format_string("%.3f", c) for c in "xyz"] + [F.format_string("%.2f", "occ"), F.col("auth"), F.lit("A"), (F.col("model") + 1).cast("string")]
    head = "data_made\n# a comment\n_entry.id made\nloop_\n" + "\n".join(f"_atom_site.{c}" for c in _COLUMNS.split()) + "\n"
    files = _joined(rows, "structure_id", _ORDER, F.concat_ws(" ", *parts))
    return files.select(F.concat("structure_id", F.when(_vid() % 2 == 0, ".cif.gz").otherwise(".CIF")).alias("name"), F.concat(F.lit(head), "content", F.lit("\n#\nloop_\n_other.id\n1\n2\n")).alias("content"))


_FILES = """
, fa0 AS (SELECT structure_id, CAST(substr(structure_id, 2) AS BIGINT) AS vid, residue_name, residue_ord AS ro, atom_ord, name, element, x, y, z, CASE WHEN residue_ord < 100 THEN split_part(residue_key, '/', 3) ELSE CAST(residue_ord AS VARCHAR) END AS num FROM atm),
fa1 AS (SELECT *, '0' AS model, name = 'CB' AND vid % 3 < 2 AS two, CASE WHEN name = 'CB' AND vid % 3 = 1 THEN 0.5 ELSE 0 END AS more FROM fa0 UNION ALL SELECT *, '1', false, 0 FROM fa0 WHERE vid % 5 = 0 AND residue_name = 'LIG'),
fa AS (SELECT structure_id, model, num, residue_name, ro, atom_ord, name, element, CAST(CAST(round(x + more, 3) AS FLOAT) AS DOUBLE) AS x, CAST(CAST(round(y + more, 3) AS FLOAT) AS DOUBLE) AS y, CAST(CAST(round(z + more, 3) AS FLOAT) AS DOUBLE) AS z,
  CASE WHEN more > 0 THEN 'B' WHEN two THEN 'A' END AS altloc, CAST(CASE WHEN two THEN 0.6 ELSE 1.0 END AS DOUBLE) AS occupancy, structure_id || '/' || model || '/A/' || num || '/' || residue_name AS residue_key,
  CAST(dense_rank() OVER (PARTITION BY structure_id, model ORDER BY ro) - 1 AS INTEGER) AS residue_ord FROM fa1),
fr AS (SELECT DISTINCT structure_id, model AS model_id, residue_key, residue_ord, residue_name, num, ro FROM fa),
one3(residue_name, one_letter) AS (SELECT DISTINCT residue_name, letter FROM pos WHERE letter IS NOT NULL)
"""
_FILE_ATOMS = f"{_FILES} SELECT structure_id, residue_key, residue_ord, residue_name, CAST(atom_ord AS INTEGER) AS atom_ord, name, element, {_q('x', 'y', 'z')}, altloc, {_q('occupancy')} FROM fa"


def _read(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    folder = _folder(spark, sf_dir, kind)
    write_files({"pdb": _pdb_files, "mmcif": _mmcif_files}[kind](spark, sf_dir), folder)
    return structures.read(spark, folder)


@query(_FILE_ATOMS)
def source_pdb_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(structures.atoms(_read(spark, sf_dir, "pdb")))


@query(_FILE_ATOMS)
def source_mmcif_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(structures.atoms(_read(spark, sf_dir, "mmcif")))


_FILE_RESIDUES = f"{_FILES} SELECT structure_id, model_id, 'A' AS chain_id, regexp_extract(num, '^[0-9]+') AS auth_seq_id, nullif(regexp_extract(num, '[A-Z]$'), '') AS insertion_code, residue_name, LABEL_SEQ AS label_seq_id, one_letter, one_letter IS NOT NULL AS is_standard, residue_ord, residue_key FROM fr LEFT JOIN one3 USING (residue_name)"


@query(_FILE_RESIDUES.replace("LABEL_SEQ", "CAST(NULL AS VARCHAR)"))
def source_pdb_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.residues(_read(spark, sf_dir, "pdb")).drop("line")


@query(_FILE_RESIDUES.replace("LABEL_SEQ", "CASE WHEN ro < 100 THEN CAST(ro + 1 AS VARCHAR) END"))
def source_mmcif_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.residues(_read(spark, sf_dir, "mmcif")).drop("line")


@query(f"{_FILES} SELECT structure_id, model_id, 'A' AS chain_id, string_agg(coalesce(one_letter, 'X'), '' ORDER BY residue_ord) AS sequence, CAST(count(*) AS INTEGER) AS residue_count, 0 AS chain_ord FROM fr LEFT JOIN one3 USING (residue_name) WHERE model_id = '0' GROUP BY structure_id, model_id")
def source_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chain of each structure; an explicit id that a structure lacks is an error."""
    every = structures.chains(structures.residues(_read(spark, sf_dir, "pdb")))
    return structures.select_chain(every.filter("model_id = '0'"), "A").join(structures.select_chain(every).select("structure_id", "model_id", "chain_id"), ["structure_id", "model_id", "chain_id"])


_ROWS = """, fs AS (SELECT label, vec_id, structure_id, string_agg(CASE WHEN left_out THEN '-' ELSE coalesce(letter, 'X') END, '' ORDER BY i) AS row FROM pos GROUP BY label, vec_id, structure_id)"""


def _fasta_files(spark: SparkSession, sf_dir: str, aligned: bool) -> DataFrame:
    """A file for each family, its sequences in lines of seven letters, lower case in every second record."""
    rows = derived.rows_of_structures(spark, sf_dir).join(_structures(spark, sf_dir), "structure_id")
    letters = F.col("row") if aligned else F.translate("row", "-", "")
    letters = F.when(F.col("ord") % 2 == 0, F.lower(letters)).otherwise(letters)
    record = F.concat(F.lit(">"), "structure_id", F.lit(" family "), F.col("group_id").cast("string"), F.lit("\n"), F.regexp_replace(letters, "(.{7})", "$1\n"))
    return _joined(rows, "group_id", ["ord"], record).select(F.concat(F.col("group_id").cast("string"), F.lit(".fasta")).alias("name"), "content")


def _family(path: str = "path") -> Column:
    return F.regexp_extract(path, "([^/]+)[.]fasta$", 1)


@query(f"{_ROWS} SELECT CAST(label AS VARCHAR) AS family, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS seq_ord, structure_id AS identifier, structure_id || ' family ' || label AS description, replace(row, '-', '') AS sequence FROM fs")
def source_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, sf_dir, "fasta")
    write_files(_fasta_files(spark, sf_dir, False), folder)
    return sequences.read_fasta(spark, folder).select(_family().alias("family"), "seq_ord", "identifier", "description", "sequence")


@query(f"{_ROWS} SELECT CAST(label AS VARCHAR) AS alignment_id, CAST(vec_id AS INTEGER) AS seq_ord, structure_id AS identifier, row FROM fs")
def source_aligned_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, sf_dir, "aligned")
    write_files(_fasta_files(spark, sf_dir, True), folder)
    rows = sequences.read_fasta(spark, folder).select(_family().alias("alignment_id"), "identifier", "sequence")
    expected = _structures(spark, sf_dir).select(F.col("group_id").cast("string").alias("alignment_id"), F.col("structure_id").alias("identifier"), F.col("ord").cast("int").alias("seq_ord"))
    return msa.parse_aligned(rows, expected).select("alignment_id", "seq_ord", "identifier", "row")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structural alignment report for each pair, in the words of the program: two scores, three lines of alignment, a matrix of the pair's fit."""
    fit = _analysis(spark, sf_dir).transforms()
    rows = derived.alignments(spark, sf_dir).join(fit, "pair_id").join(_analysis(spark, sf_dir).summary().select("pair_id", "identity"), "pair_id")
    number = lambda array, k: F.round(F.get(array, F.lit(k)), 10)
    matrix = [F.format_string("%d %.10f %.10f %.10f %.10f", F.lit(i), number("translation", i), *[number("rotation", 3 * i + j) for j in range(3)]) for i in range(3)]
    marks = F.regexp_replace("aligned_reference", ".", ":")
    score = F.format_string("%.5f", F.round("identity", 5))
    lines = [F.lit(" * US-align (Version 20240730)"), F.concat(F.lit("Name of Structure_1: "), "reference_id"), F.concat(F.lit("Name of Structure_2: "), "target_id"), F.concat(F.lit("TM-score= "), score, F.lit(" (normalized by length of Structure_1)"))]
    lines += [F.lit("TM-score= 0.11111 (normalized by length of Structure_2)"), F.lit(""), F.col("aligned_reference"), marks, F.col("aligned_target"), F.lit(""), F.lit("m t[m] u[m][0] u[m][1] u[m][2]"), *matrix]
    return rows.select(F.col("pair_id").alias("path"), F.concat_ws("\n", *lines).alias("content"))


@query(f"""SELECT cor.pair_id, '20240730' AS version, {_q('round(any_value(identity), 5) AS tm_score')}, string_agg(coalesce(reference_aa, '-'), '' ORDER BY alignment_index) AS aligned_reference, string_agg(coalesce(target_aa, '-'), '' ORDER BY alignment_index) AS aligned_target,
  {_q('any_value(u00) AS r0', 'any_value(u21) AS r5', 'any_value(u12) AS r7', 'any_value(d0) AS t0', 'any_value(d2) AS t2')}
FROM cor JOIN rot USING (pair_id) JOIN met USING (pair_id) GROUP BY cor.pair_id""")
def source_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.parse_report(_reports(spark, sf_dir)).filter("path = concat(name_1, '|', name_2)")
    r, t = (lambda k: F.get("rotation", F.lit(k))), (lambda k: F.get("translation", F.lit(k)))
    return out.select(F.col("path").alias("pair_id"), "version", _r("tm_score").alias("tm_score"), "aligned_reference", "aligned_target", _r(r(0)).alias("r0"), _r(r(5)).alias("r5"), _r(r(7)).alias("r7"), _r(t(0)).alias("t0"), _r(t(2)).alias("t2"))


@query("""SELECT pair_id, alignment_index, reference_aa, target_aa, CASE WHEN reference_aa IS NULL THEN 'insertion' WHEN target_aa IS NULL THEN 'deletion' WHEN reference_aa = target_aa THEN 'conserved' ELSE 'substitution' END AS status, 'structure' AS mapping_source FROM cor""")
def structural_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.parse_report(_reports(spark, sf_dir)).select(F.col("path").alias("pair_id"), F.col("name_1").alias("reference_id"), F.col("name_2").alias("target_id"), "aligned_reference", "aligned_target")
    return correspondence.from_report(found).select("pair_id", "alignment_index", "reference_aa", "target_aa", "status", "mapping_source")


def _manual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped residues of each pair, a line each, in all three spellings, with comments."""
    rows = _analysis(spark, sf_dir).correspondence().filter("reference_key is not null and target_key is not null")
    sign = F.get(F.array(F.lit(" -> "), F.lit(" = "), F.lit(",")), (F.col("alignment_index") % 3).cast("int"))
    line = F.concat("reference_label", sign, "target_label", F.when(F.col("alignment_index") % 4 == 0, " # a comment").otherwise(""))
    text = _joined(rows, "pair_id", ["alignment_index"], line)
    return sequences.parse_manual_pairs(text.select("pair_id", F.concat(F.lit("# pairs\n\n"), "content").alias("content")))


_MANUAL = "SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY alignment_index) + 1 AS INTEGER) AS pair_ord, 'A:' || rnum AS reference_token, 'A:' || tnum AS target_token FROM cor WHERE mapped"


@query(_MANUAL)
def source_manual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manual_pairs(spark, sf_dir)


@query("SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY alignment_index) + 1 AS INTEGER) AS alignment_index, reference_key, target_key, reference_aa, target_aa, status, 'manual' AS mapping_source, true AS mapping_locked FROM cor WHERE mapped")
def manual_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _manual_pairs(spark, sf_dir).join(derived.pairs(spark, sf_dir), "pair_id")
    return correspondence.manual_mapping(pairs, derived.residues(spark, sf_dir)).drop("reference_id", "target_id")


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project document for each reference, every second one without key residues and settings, in each known version."""
    pairs = derived.pairs(spark, sf_dir).groupBy("reference_id").agg(F.array_sort(F.collect_list("target_id")).alias("targets"))
    full = _vid("reference_id") % 2 == 0
    version = F.get(F.array(*[F.lit(v) for v in sequences.VERSIONS]), (_vid("reference_id") % 3).cast("int"))
    keys = F.when(full, F.array(F.concat("reference_id", F.lit("/A/3"))))
    return pairs.select(F.col("reference_id").alias("path"), F.to_json(F.struct(version.alias("version"), "reference_id", "targets", keys.alias("key_residues"), F.when(full, F.create_map(F.lit("mode"), F.lit("auto"))).alias("settings"))).alias("content"))


@query(f"""SELECT reference_id, (['0.1', '0.2', '3.0'])[CAST(substr(reference_id, 2) AS BIGINT) % 3 + 1] AS version, string_agg(target_id, ',' ORDER BY target_id) AS targets, CASE WHEN CAST(substr(reference_id, 2) AS BIGINT) % 2 = 0 THEN reference_id || '/A/3,' ELSE '' END || 'added' AS key_residues,
  CASE WHEN CAST(substr(reference_id, 2) AS BIGINT) % 2 = 0 THEN 'auto' END AS mode FROM prs GROUP BY reference_id""")
def source_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, sf_dir, "projects")
    write_files(_projects(spark, sf_dir).select(F.concat("path", F.lit(".json")).alias("name"), "content"), folder)
    own = sequences.parse_projects(spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    own = sequences.with_key_residue(sequences.with_key_residue(own, "added"), "added")
    return own.select("reference_id", "version", F.array_join("targets", ",").alias("targets"), F.array_join("key_residues", ",").alias("key_residues"), F.col("settings")["mode"].alias("mode"))


# ---- Sinks ---------------------------------------------------------------------------------------


_SHEET = """SELECT pair_id, alignment_index, CASE WHEN reference_key IS NOT NULL THEN 'A:' || rnum || ' ' || rname END AS reference, CASE WHEN target_key IS NOT NULL THEN 'A:' || tnum || ' ' || tname END AS target, status, CASE WHEN mapped THEN round(ca_displacement, 4) + 0.0 END AS ca_displacement FROM mov"""


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sinks.residue_sheet(_analysis(spark, sf_dir).moved()))


@query(_SHEET)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folder = _sheet(spark, sf_dir), _folder(spark, sf_dir, "csv")
    sinks.write_csv(rows, folder)
    return spark.read.schema(rows.schema).csv(folder, header=True)


@query("SELECT pair_id, alignment_index, kind, reference_label, target_label, notation FROM ev")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations as JSON lines, nulls included, read back."""
    rows = _analysis(spark, sf_dir).mutations().select("pair_id", "alignment_index", "kind", "reference_label", "target_label", "notation")
    folder = _folder(spark, sf_dir, "json")
    sinks.as_json(rows).write.mode("overwrite").text(folder)
    return spark.read.schema(rows.schema).json(folder)


@query(_SHEET)
def sink_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, sf_dir, "sheets")
    sinks.write_sheets({"Residues": _sheet(spark, sf_dir)}, folder)
    return spark.read.parquet(f"{folder}/Residues")


@query(f"{_ROWS} SELECT CAST(label AS VARCHAR) || '.fasta' AS name, sha256(string_agg('>' || structure_id || ' family ' || label || chr(10) || regexp_replace(CASE WHEN vec_id % 2 = 0 THEN lower(replace(row, '-', '')) ELSE replace(row, '-', '') END, '(.{{7}})', '\\1' || chr(10), 'g'), chr(10) ORDER BY vec_id)) AS sha256 FROM fs GROUP BY label")
def source_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, sf_dir, "hashed")
    write_files(_fasta_files(spark, sf_dir, False), folder)
    return structures.with_hashes(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")


# ---- Stream --------------------------------------------------------------------------------------


@query(_FILE_RESIDUES.replace("LABEL_SEQ", "CAST(NULL AS VARCHAR)"))
def stream_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residues of files that arrive in a folder, in several batches, then read as one table."""
    import uuid

    folder = _folder(spark, sf_dir, "arriving")
    write_files(_pdb_files(spark, sf_dir), folder)
    out = _folder(spark, sf_dir, f"streamed-{uuid.uuid4().hex}")
    append_residues(spark, folder, f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch", "line")


# ---- Small files of the driver, chart sheets, validation, viewers --------------------------------


def read_workbook(path: str, sheet: int = 1) -> list[list[str | None]]:
    """The cells of a sheet of write_workbook, row by row, the header first; blank ones are None."""
    import xml.etree.ElementTree as ET
    import zipfile

    with zipfile.ZipFile(path) as z:
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    return [["".join(c.itertext()) if len(c) else None for c in row.iter(f"{space}c")] for row in root.iter(f"{space}row")]


_FEW = ["pair_id", "identity", "coverage", "strict_rmsd", "mapped_count", "decision"]
_FEW_SQL = f"SELECT pair_id, identity, coverage, strict_rmsd, mapped_count, decision FROM ({registry._SUMMARY})"


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_analysis(spark, sf_dir).summary().select(*_FEW))


@query(_FEW_SQL)
def sink_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of all pairs as a workbook, whose cells are read back. The file is the driver's; tables longer than SHEET_ROWS take several sheets."""
    import os
    import tempfile
    import zipfile

    rows = _few(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        sinks.write_workbook({"Summary": rows}, path := os.path.join(folder, "o.xlsx"))
        with zipfile.ZipFile(path) as z:
            sheets = sum(n.startswith("xl/worksheets/") for n in z.namelist())
        head = read_workbook(path)[0]
        cells = [r for i in range(1, sheets + 1) for r in read_workbook(path, i)[1:]]
    text = spark.createDataFrame([tuple(r) for r in cells], ", ".join(f"{c} string" for c in head))
    return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema])


@query(_FEW_SQL)
def sink_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a bundle, checked and read back."""
    import json
    import os
    import tempfile
    import zipfile

    rows = _few(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        sinks.write_bundle({"residues": rows}, path := os.path.join(folder, "o.zip"), "all", "auto", [])
        sinks.validate_bundle(path)
        with zipfile.ZipFile(path) as z:
            found = json.loads(z.read("residues.json"))
    return spark.createDataFrame([tuple(r[c] for c in _FEW) for r in found], rows.schema)


@query(registry.ORACLE_SQL["source_projects"].partition("WITH ")[2].partition(registry._TABLES + "\n")[2])
def sink_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project documents parsed, written as JSON and parsed again."""
    texts = _projects(spark, sf_dir)
    own = sequences.with_key_residue(sequences.parse_projects(texts), "added")
    folder = _folder(spark, sf_dir, "projects-out")
    write_files(sinks.as_json(own.drop("path")).select(F.concat(F.get_json_object("value", "$.reference_id"), F.lit(".json")).alias("name"), F.col("value").alias("content")), folder)
    back = sequences.parse_projects(spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    return back.select("reference_id", "version", F.array_join("targets", ",").alias("targets"), F.array_join("key_residues", ",").alias("key_residues"), F.col("settings")["mode"].alias("mode"))


@query(registry.ORACLE_SQL["chart_deviation"].partition(registry._TABLES + "\n")[2])
def sink_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart's long table as a CSV sheet, read back."""
    rows, folder = _rounded(charts.deviation_profile(_analysis(spark, sf_dir).moved())), _folder(spark, sf_dir, "charts")
    sinks.write_sheets({"deviation": rows}, folder, "csv")
    return spark.read.schema(rows.schema).csv(f"{folder}/deviation", header=True)


@query("""SELECT pair_id, alignment_index, false AS locked, coalesce(mapped AND ca_displacement > 2.0, false) AS is_outlier, alignment_index = 1 AND (reference_key IS NOT NULL OR target_key IS NOT NULL) AS is_duplicate FROM mov
UNION ALL SELECT pair_id, 1001, false, coalesce(mapped AND ca_displacement > 2.0, false), reference_key IS NOT NULL OR target_key IS NOT NULL FROM mov WHERE alignment_index = 1
UNION ALL SELECT pair_id, 1002, true, coalesce(mapped AND ca_displacement > 2.0, false), false FROM mov WHERE alignment_index = 2""")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which one stands twice, and one a second time but locked."""
    rows = _analysis(spark, sf_dir).moved().withColumn("mapping_locked", F.lit(False))
    again = rows.filter("alignment_index in (1, 2)").withColumns({"mapping_locked": F.col("alignment_index") == 2, "alignment_index": F.col("alignment_index") + 1000})
    return correspondence.validate(rows.unionByName(again)).select("pair_id", "alignment_index", F.col("mapping_locked").alias("locked"), "is_outlier", "is_duplicate")


@query("""SELECT pair_id, alignment_index, lower(regexp_replace(pair_id || ' ' || status, '[^A-Za-z0-9_]+', '_', 'g')) AS name, CASE WHEN reference_key IS NOT NULL THEN 'chain A and resi ' || rnum END AS selection, CASE WHEN reference_key IS NOT NULL THEN 'A:' || rnum ELSE '—' END AS label,
  CASE status WHEN 'conserved' THEN 'slate' WHEN 'substitution' THEN 'orange' WHEN 'insertion' THEN 'yellow' WHEN 'deletion' THEN 'red' WHEN 'nonstandard' THEN 'magenta' END AS color FROM cor""")
def viewer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _analysis(spark, sf_dir).correspondence()
    return rows.select("pair_id", "alignment_index", charts.selection_name(F.concat("pair_id", F.lit(" "), "status")).alias("name"), charts.residue_selection(F.when(F.col("reference_key").isNotNull(), "A"), F.col("reference_num")).alias("selection"), charts.label("reference").alias("label"), charts.status_color(F.col("status")).alias("color"))
