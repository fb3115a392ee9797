"""Structures derived from the embeddings table, so that SQL over the same tables can check the operators.

A row of embeddings is a chain of 21 positions: three numbers each are the place
of a C-alpha atom. Letters follow from the place and the family (label); the
lowest vec_id of a family is its reference. Some positions are left out of each
chain, so that alignments have gaps on either side; a few residues are
non-standard, one carries an insertion code, and each structure has a ligand and
a metal ion.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.functions.lookups import CANONICAL, RINGS, THREE_LETTERS

LENGTH = 21
SCALE = 10


def _template() -> list[tuple[str, int, str, str, float, float, float]]:
    """(residue, ord, atom, element, dx, dy, dz): a made-up side chain for every residue, rings as flat polygons."""
    side = {
        "A": "", "G": None, "V": "CG1 CG2", "L": "CG CD1 CD2", "I": "CG1 CG2 CD1", "M": "CG SD CE", "P": "CG CD", "F": "", "W": "", "Y": "OH", "S": "OG", "T": "OG1 CG2",
        "N": "CG OD1 ND2", "Q": "CG CD OE1 NE2", "C": "SG", "K": "CG CD CE NZ", "R": "CG CD NE CZ NH1 NH2", "H": "", "D": "CG OD1 OD2", "E": "CG CD OE1 OE2",
    }
    out = []
    names = {**{three: side[one] for one, three in THREE_LETTERS.items()}, "MSE": "CG SE CE"}
    for residue, rest in sorted(names.items()):
        atoms = {"N": (-1.2, 0.3, 0.1), "CA": (0.0, 0.0, 0.0), "C": (1.2, -0.3, 0.2), "O": (1.5, -1.3, 0.6)}
        if rest is not None:
            atoms["CB"] = (0.1, 1.2, -0.8)
            for k, ring in enumerate([ring for (name, _), ring in sorted(RINGS.items()) if name == residue]):
                for i, atom in enumerate(ring):
                    turn = 2 * math.pi * i / len(ring)
                    atoms.setdefault(atom, (round(0.2 + 1.3 * math.cos(turn) + k, 3), round(3.1 + 1.3 * math.sin(turn) + k, 3), round(-1.4 + 0.4 * math.sin(turn), 3)))
            for i, atom in enumerate(rest.split()):
                atoms[atom] = (round(0.3 + 0.7 * (i % 3), 3), round(2.3 + 0.9 * i, 3), round(-1.1 - 0.6 * (i % 2), 3))
        out += [(residue, i, atom, "SE" if atom == "SE" else atom[0], *place) for i, (atom, place) in enumerate(atoms.items())]
    return out


TEMPLATE = _template()


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions before any is left out: structure_id, vec_id, label, is_reference, i, residue fields, x, y, z."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    family = raw.groupBy("label").agg(F.min("vec_id").alias("ref_id"))
    place = lambda k: F.get("embedding", F.col("i") * 3 + k).cast("double") * SCALE
    rows = raw.join(F.broadcast(family), "label").select("*", F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1))).alias("i"))
    rows = rows.withColumns({"x": place(0), "y": place(1), "z": place(2)}).withColumn("k", F.floor(F.col("x") * 7))
    mutated = F.pmod("k", F.lit(3)) == 0
    index = F.when(mutated, F.pmod(F.col("k") + F.col("label"), F.lit(20))).otherwise(F.pmod(F.col("i") * 3 + F.col("label"), F.lit(20))).cast("int")
    odd = F.pmod("k", F.lit(17)) == 0
    letter = F.when(~odd, F.substring(F.lit(CANONICAL), index + 1, F.lit(1)))
    names = F.array(*[F.lit(THREE_LETTERS[c]) for c in CANONICAL])
    name = F.when(odd, F.lit("MSE")).otherwise(F.get(names, index))
    auth = F.when(F.col("i") < 5, F.col("i") + 1).otherwise(F.col("i")).cast("string")
    insertion = F.when(F.col("i") == 5, F.lit("A"))
    is_reference = F.col("vec_id") == F.col("ref_id")
    left_out = F.when(is_reference, F.pmod("i", F.lit(11)) == F.pmod("label", F.lit(11))).otherwise(F.pmod("i", F.lit(7)) == F.pmod("vec_id", F.lit(7)))
    structure = F.concat(F.lit("v"), F.col("vec_id"))
    return rows.select(
        structure.alias("structure_id"), "vec_id", "label", "ref_id", is_reference.alias("is_reference"), "i", left_out.alias("left_out"), F.lit("A").alias("chain_id"),
        auth.alias("auth_seq_id"), insertion.alias("insertion_code"), name.alias("residue_name"), letter.alias("one_letter"), letter.isNotNull().alias("is_standard"),
        F.concat_ws("/", structure, F.lit("A"), F.concat(auth, F.coalesce(insertion, F.lit("")))).alias("residue_key"), "x", "y", "z",
    )


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain residues: residue_ord counts them from 0 in a chain."""
    rows = positions(spark, sf_dir).filter("not left_out")
    # Positions are left out by a rule, so that a residue's place follows without a window.
    skip = F.when(F.col("is_reference"), F.pmod("label", F.lit(11))).otherwise(F.pmod("vec_id", F.lit(7)))
    step = F.when(F.col("is_reference"), 11).otherwise(7)
    before = F.when(F.col("i") > skip, F.floor((F.col("i") - skip - 1) / step) + 1).otherwise(0)
    return rows.withColumn("residue_ord", (F.col("i") - before).cast("int")).drop("left_out")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, reference_id, target_id: every other structure of a family against its reference."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    family = raw.groupBy("label").agg(F.min("vec_id").alias("ref_id"))
    both = raw.join(F.broadcast(family), "label").filter("vec_id <> ref_id")
    names = both.select(F.concat(F.lit("v"), F.col("ref_id")).alias("reference_id"), F.concat(F.lit("v"), F.col("vec_id")).alias("target_id"))
    return names.select(F.concat_ws("|", "reference_id", "target_id").alias("pair_id"), "reference_id", "target_id")


def rows_of_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure_id, row: the letters of all positions, X where non-standard, - where left out."""
    cell = F.when(F.col("left_out"), "-").otherwise(F.coalesce("one_letter", F.lit("X")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", cell.alias("c")))), lambda s: s["c"]), "")
    return positions(spark, sf_dir).groupBy("structure_id").agg(joined.alias("row"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, reference_id, target_id, aligned_reference, aligned_target; columns with a gap on both sides are left out."""
    rows = rows_of_structures(spark, sf_dir)
    both = pairs(spark, sf_dir).join(rows.withColumnsRenamed({"structure_id": "reference_id", "row": "r"}), "reference_id").join(rows.withColumnsRenamed({"structure_id": "target_id", "row": "t"}), "target_id")
    cells = F.filter(F.arrays_zip(F.split("r", ""), F.split("t", "")), lambda s: (s["0"] != "-") | (s["1"] != "-"))
    both = both.withColumn("cells", cells)
    joined = [F.array_join(F.transform("cells", lambda s: s["0"]), "").alias("aligned_reference"), F.array_join(F.transform("cells", lambda s: s["1"]), "").alias("aligned_target")]
    return both.select("pair_id", "reference_id", "target_id", *joined)


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All atoms, ligand and ion included: structure_id, residue_key, residue_ord, residue_name, atom_ord, name, element, x, y, z."""
    own = residues(spark, sf_dir)
    template = spark.createDataFrame(TEMPLATE, "residue_name string, atom_ord int, name string, element string, dx double, dy double, dz double")
    moved = [(F.col(c) + F.col(f"d{c}")).alias(c) for c in "xyz"]
    chain = own.join(F.broadcast(template), "residue_name").select("structure_id", "residue_key", "residue_ord", "residue_name", "atom_ord", "name", "element", *moved)
    extra = [("LIG", "C1", "C", 100, 10, 0.5, 0.5, 0.5), ("ZN", "ZN", "ZN", 101, 3, 1.6, 0.9, 0.6)]
    added = spark.createDataFrame(extra, "residue_name string, name string, element string, residue_ord int, i int, dx double, dy double, dz double")
    hetero = positions(spark, sf_dir).select("structure_id", "i", "x", "y", "z").join(F.broadcast(added), "i").select("structure_id", F.concat_ws("/", "structure_id", "residue_name").alias("residue_key"), "residue_ord", "residue_name", F.lit(0).alias("atom_ord"), "name", "element", *moved)
    return chain.unionByName(hetero)


# ---- The same as SQL ----------------------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if not isinstance(x, float) else f"CAST({x!r} AS DOUBLE)" for x in r) + ")" for r in rows)


SQL = f"""
raw AS (SELECT vec_id, label, min(vec_id) OVER (PARTITION BY label) AS ref_id, embedding FROM embeddings),
pos0 AS (SELECT vec_id, label, ref_id, i, CAST(embedding[3 * i + 1] AS DOUBLE) * 10 AS x, CAST(embedding[3 * i + 2] AS DOUBLE) * 10 AS y, CAST(embedding[3 * i + 3] AS DOUBLE) * 10 AS z
  FROM (SELECT *, unnest(range(0, 21)) AS i FROM raw)),
pos1 AS (SELECT *, CAST(floor(x * 7) AS BIGINT) AS k FROM pos0),
pos2 AS (SELECT *, ((k % 17) + 17) % 17 = 0 AS odd, CASE WHEN ((k % 3) + 3) % 3 = 0 THEN (((k + label) % 20) + 20) % 20 ELSE (i * 3 + label) % 20 END AS idx FROM pos1),
pos AS (SELECT 'v' || vec_id AS structure_id, vec_id, label, 'v' || ref_id AS ref_id, vec_id = ref_id AS is_reference, i,
  CASE WHEN vec_id = ref_id THEN i % 11 = label % 11 ELSE i % 7 = vec_id % 7 END AS left_out,
  CAST(CASE WHEN i < 5 THEN i + 1 ELSE i END AS VARCHAR) || CASE WHEN i = 5 THEN 'A' ELSE '' END AS num,
  CASE WHEN odd THEN NULL ELSE substr('{CANONICAL}', CAST(idx + 1 AS INTEGER), 1) END AS letter,
  CASE WHEN odd THEN 'MSE' ELSE ([{", ".join(repr(THREE_LETTERS[c]) for c in CANONICAL)}])[idx + 1] END AS residue_name, x, y, z FROM pos2),
res AS (SELECT *, structure_id || '/A/' || num AS residue_key, row_number() OVER (PARTITION BY structure_id ORDER BY i) - 1 AS residue_ord FROM pos WHERE NOT left_out),
prs AS (SELECT DISTINCT ref_id || '|' || structure_id AS pair_id, ref_id AS reference_id, structure_id AS target_id FROM pos WHERE NOT is_reference),
cor0 AS (SELECT p.*, r.i, r.left_out AS ro, t.left_out AS to_, r.letter AS rl, t.letter AS tl, r.num AS rnum, t.num AS tnum, r.residue_name AS rname, t.residue_name AS tname,
    r.structure_id || '/A/' || r.num AS rkey, t.structure_id || '/A/' || t.num AS tkey, r.x AS rx, r.y AS ry, r.z AS rz, t.x AS tx, t.y AS ty, t.z AS tz
  FROM prs p JOIN pos r ON r.structure_id = p.reference_id JOIN pos t ON t.structure_id = p.target_id AND t.i = r.i WHERE NOT (r.left_out AND t.left_out)),
cor AS (SELECT pair_id, reference_id, target_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY i) - 1 AS INTEGER) AS alignment_index,
    CASE WHEN NOT ro THEN rkey END AS reference_key, CASE WHEN NOT to_ THEN tkey END AS target_key,
    CASE WHEN NOT ro THEN coalesce(rl, 'X') END AS reference_aa, CASE WHEN NOT to_ THEN coalesce(tl, 'X') END AS target_aa,
    CASE WHEN ro THEN 'insertion' WHEN to_ THEN 'deletion' WHEN rl IS NULL OR tl IS NULL THEN 'nonstandard' WHEN rl = tl THEN 'conserved' ELSE 'substitution' END AS status,
    CASE WHEN NOT ro THEN rnum END AS rnum, CASE WHEN NOT to_ THEN tnum END AS tnum, CASE WHEN NOT ro THEN rname END AS rname, CASE WHEN NOT to_ THEN tname END AS tname,
    NOT ro AND NOT to_ AS mapped, rx, ry, rz, tx, ty, tz FROM cor0),
tmpl(residue_name, atom_ord, name, element, dx, dy, dz) AS (VALUES {_values(TEMPLATE)}),
atm AS (SELECT structure_id, residue_key, residue_ord, residue_name, atom_ord, name, element, x + dx AS x, y + dy AS y, z + dz AS z FROM res JOIN tmpl USING (residue_name)
  UNION ALL SELECT structure_id, structure_id || '/' || h.rn, h.ro, h.rn, 0, h.nm, h.el, x + h.dx, y + h.dy, z + h.dz
  FROM pos JOIN (VALUES ('LIG', 'C1', 'C', 100, 10, CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE)), ('ZN', 'ZN', 'ZN', 101, 3, CAST(1.6 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(0.6 AS DOUBLE))) h(rn, nm, el, ro, at_, dx, dy, dz) ON i = at_)
"""
