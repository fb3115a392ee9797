"""The registered queries over derived structures, and SQL that gives the same rows.

Doubles are rounded to four places on both sides: sums come in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldframe.functions import lookups as L
from foldframe.operators import charts, correspondence, distances, evidence, interactions, msa, multi, sites, superposition
from foldframe.operators.alignment import align_pairs
from foldframe.plans import derived
from foldframe.plans.engine import Analysis
from foldframe.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PLACES = 4
RADIUS = 4.0


def query(sql: str | None = None) -> Callable:
    """Registers a function under its own name, with the SELECT that follows the shared table expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {_TABLES}\n{sql}"
        return f

    return add


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, PLACES) + 0.0


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(_r(c) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def _analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return Analysis(derived.alignments(spark, sf_dir), derived.residues(spark, sf_dir), derived.atoms(spark, sf_dir))


# ---- Table expressions shared by the SQL ---------------------------------------------------------


def _q(*cols: str) -> str:
    """SQL of rounded doubles."""
    return ", ".join(f"round({c.split(' AS ')[0]}, {PLACES}) + 0.0 AS {c.split(' AS ')[-1].split('.')[-1]}" for c in cols)


def _newton() -> str:
    """The largest root of the characteristic polynomial, by 30 steps from above; the rotation from the cofactors of its matrix."""
    k = {
        (0, 0): "sxx + syy + szz", (0, 1): "syz - szy", (0, 2): "szx - sxz", (0, 3): "sxy - syx", (1, 1): "sxx - syy - szz", (1, 2): "sxy + syx", (1, 3): "szx + sxz",
        (2, 2): "-sxx + syy - szz", (2, 3): "syz + szy", (3, 3): "-sxx - syy + szz",
    }
    cell = lambda i, j, less="": f"k{min(i, j)}{max(i, j)}" if i != j or not less else f"(k{i}{j} - {less})"

    def det3(rows, cols, less=""):
        a = [[cell(i, j, less) for j in cols] for i in rows]
        return f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"

    def cofactor(j, less=""):
        return f"{'-' if j % 2 else ''}{det3([1, 2, 3], [x for x in range(4) if x != j], less)}"

    det = " + ".join(f"{cell(0, j)} * ({cofactor(j)})" for j in range(4))
    step = "SELECT *, lam0 AS lam FROM (SELECT *, e0 AS lam0 FROM coef)"
    for _ in range(30):
        step = f"SELECT * REPLACE (lam - (((lam * lam + c2) * lam + c1) * lam + c0) / nullif((4 * lam * lam + 2 * c2) * lam + c1, 0) AS lam) FROM ({step})"
    s = lambda a, b: f"covar_pop(t{a}, r{b}) * count(*) AS s{a}{b}"
    return f"""
mom AS (SELECT pair_id, count(*) AS n, {", ".join(s(a, b) for a in "xyz" for b in "xyz")}, {", ".join(f"avg({p}{c}) AS m{p}{c}" for p in "rt" for c in "xyz")},
  ({" + ".join(f"var_pop({p}{c})" for p in "rt" for c in "xyz")}) * count(*) / 2 AS e0 FROM cor WHERE mapped GROUP BY pair_id),
kk AS (SELECT *, {", ".join(f"{v} AS k{i}{j}" for (i, j), v in k.items())} FROM mom),
coef AS (SELECT *, -2 * ({" + ".join(f"s{a}{b} * s{a}{b}" for a in "xyz" for b in "xyz")}) AS c2,
  -8 * (sxx * (syy * szz - syz * szy) - sxy * (syx * szz - syz * szx) + sxz * (syx * szy - syy * szx)) AS c1, {det} AS c0 FROM kk),
root AS ({step}),
quat0 AS (SELECT *, {", ".join(f"{cofactor(j, 'lam')} AS p{j}" for j in range(4))} FROM root),
quat AS (SELECT *, {", ".join(f"p{j} / sqrt(p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3) AS q{j}" for j in range(4))} FROM quat0),
rot0 AS (SELECT *, q0 * q0 + q1 * q1 - q2 * q2 - q3 * q3 AS u00, 2 * (q1 * q2 - q0 * q3) AS u01, 2 * (q1 * q3 + q0 * q2) AS u02, 2 * (q1 * q2 + q0 * q3) AS u10,
  q0 * q0 - q1 * q1 + q2 * q2 - q3 * q3 AS u11, 2 * (q2 * q3 - q0 * q1) AS u12, 2 * (q1 * q3 - q0 * q2) AS u20, 2 * (q2 * q3 + q0 * q1) AS u21, q0 * q0 - q1 * q1 - q2 * q2 + q3 * q3 AS u22 FROM quat),
rot AS (SELECT *, sqrt(greatest(2 * (e0 - lam) / n, 0)) AS strict_rmsd, {", ".join(f"mr{c} - (u{j}0 * mtx + u{j}1 * mty + u{j}2 * mtz) AS d{j}" for j, c in enumerate("xyz"))} FROM rot0),
mov0 AS (SELECT cor.*, {", ".join(f"CASE WHEN mapped THEN u{j}0 * tx + u{j}1 * ty + u{j}2 * tz + d{j} END AS m{c}" for j, c in enumerate("xyz"))} FROM cor LEFT JOIN rot USING (pair_id)),
mov AS (SELECT *, sqrt((mx - rx) * (mx - rx) + (my - ry) * (my - ry) + (mz - rz) * (mz - rz)) AS ca_displacement FROM mov0)"""


_SCORES = ", ".join(f"('{a}', '{b}', {v}, {v if a in L.CANONICAL and b in L.CANONICAL else 'NULL'}, {L.GRANTHAM.get((a, b), 'NULL')})" for (a, b), v in sorted(L.BLOSUM62.items()))
_CATEGORIES = ", ".join(f"('{letter}', '{name}')" for letter, name in sorted(L.CATEGORY_OF.items()))
_TABLES = f"""{derived.SQL},
sub(a, b, score, blosum62, grantham) AS (VALUES {_SCORES}),
cat(letter, category) AS (VALUES {_CATEGORIES}),
scored AS (SELECT cor.*, score AS sequence_score, strpos('{L.CANONICAL}', coalesce(reference_aa, '?')) > 0 AS rc, strpos('{L.CANONICAL}', coalesce(target_aa, '?')) > 0 AS tc
  FROM cor LEFT JOIN sub ON a = reference_aa AND b = target_aa),
met0 AS (SELECT pair_id, reference_id, target_id, count(*) FILTER (rc AND tc) AS al, count(*) FILTER (rc AND tc AND reference_aa = target_aa) AS sm, count(*) FILTER (rc AND tc AND sequence_score > 0) AS lk,
  count(*) FILTER (rc) AS nr, count(*) FILTER (tc) AS nt FROM scored GROUP BY ALL),
met AS (SELECT pair_id, reference_id, target_id, coalesce(sm / nullif(al, 0), 0.0) AS identity, coalesce(lk / nullif(al, 0), 0.0) AS similarity, coalesce(al / nullif(nr, 0), 0.0) AS coverage,
  coalesce(al / nullif(nt, 0), 0.0) AS target_coverage, al AS aligned_count FROM met0),
ev AS (SELECT pair_id, alignment_index, status AS kind, CASE WHEN reference_key IS NOT NULL THEN 'A:' || rnum END AS reference_label, CASE WHEN target_key IS NOT NULL THEN 'A:' || tnum END AS target_label,
  reference_aa, target_aa, CASE status WHEN 'insertion' THEN 'insertion:' || target_aa || ':' || tnum WHEN 'deletion' THEN 'Δ' || substr(rname, 1, 1) || lower(substr(rname, 2)) || rnum
    WHEN 'nonstandard' THEN 'nonstandard:' || rname || ':' || rnum || '->' || tname || ':' || tnum ELSE reference_aa || rnum || target_aa END AS notation
  FROM (SELECT * REPLACE (CASE WHEN rname = 'MSE' OR tname = 'MSE' THEN 'nonstandard' ELSE status END AS status, coalesce(rname, '?') AS rname, coalesce(tname, '?') AS tname, coalesce(rnum, '-') AS rnum, coalesce(tnum, '-') AS tnum) FROM
    (SELECT *, rname AS rn0, tname AS tn0 FROM cor))),
{_newton()}"""


# ---- Correspondence and mutations ----------------------------------------------------------------


@query("SELECT pair_id, alignment_index, reference_key, target_key, reference_aa, target_aa, status, sequence_score FROM scored")
def correspondence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = correspondence.with_scores(_analysis(spark, sf_dir).correspondence())
    return rows.select("pair_id", "alignment_index", "reference_key", "target_key", "reference_aa", "target_aa", "status", "sequence_score")


@query(f"SELECT pair_id, reference_id, target_id, {_q('identity', 'similarity', 'coverage', 'target_coverage')}, aligned_count FROM met")
def sequence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correspondence.sequence_metrics(_analysis(spark, sf_dir).correspondence()))


_DECISION = """SELECT pair_id, mode AS mapping_mode, CASE WHEN mode = 'sequence' THEN 'sequence-guided (AUTO: identity=' || i || ' >= 0.300, coverage=' || c || ' >= 0.700)' ELSE 'structure-guided (AUTO: identity=' || i || ' or coverage=' || c || ' below thresholds)' END AS decision
FROM (SELECT *, CASE WHEN identity >= 0.30 AND coverage >= 0.70 THEN 'sequence' ELSE 'structure' END AS mode, format('{:.3f}', identity) AS i, format('{:.3f}', coverage) AS c FROM met)"""


@query(_DECISION)
def auto_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correspondence.decision(correspondence.sequence_metrics(_analysis(spark, sf_dir).correspondence())).select("pair_id", "mapping_mode", "decision")


_EVENTS = """SELECT pair_id, alignment_index, kind, reference_label, target_label, notation, CASE WHEN kind = 'substitution' THEN blosum62 END AS blosum62, CASE WHEN kind = 'substitution' THEN grantham END AS grantham,
  CASE WHEN kind = 'substitution' THEN CASE WHEN c1.category = c2.category THEN 'conservative' WHEN c1.category <> c2.category THEN 'non_conservative' END END AS class
FROM ev LEFT JOIN sub ON a = reference_aa AND b = target_aa LEFT JOIN cat c1 ON c1.letter = reference_aa LEFT JOIN cat c2 ON c2.letter = target_aa"""


@query(_EVENTS)
def mutation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).mutations()


@query(f"SELECT blosum62, grantham, class, count(*) AS n FROM ({_EVENTS}) WHERE kind = 'substitution' GROUP BY ALL")
def substitution_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).mutations().filter("kind = 'substitution'").groupBy("blosum62", "grantham", "class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT letter AS one_letter, category, count(*) AS n FROM res LEFT JOIN cat USING (letter) GROUP BY ALL")
def residue_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.residues(spark, sf_dir).groupBy("one_letter", L.category(F.col("one_letter")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_COUNTS = "SELECT pair_id, count(*) FILTER (status <> 'conserved') AS mutation_count, count(*) FILTER (status = 'insertion') AS insertion_count, count(*) FILTER (status = 'deletion') AS deletion_count, count(*) FILTER (status = 'conserved') AS conserved_count FROM cor GROUP BY pair_id"


@query(_COUNTS)
def mutation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correspondence.counts(_analysis(spark, sf_dir).correspondence())


# ---- Geometry ------------------------------------------------------------------------------------


@query(f"SELECT pair_id, {_q('strict_rmsd')}, n AS mapped_count FROM rot")
def strict_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(superposition.strict_rmsd(_analysis(spark, sf_dir).moved()))


@query(f"SELECT pair_id, {', '.join(_q(f'u{j}{i} AS r{3 * i + j}') for i in range(3) for j in range(3))}, {_q('d0 AS t0', 'd1 AS t1', 'd2 AS t2')}, n AS atom_count FROM rot")
def fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _analysis(spark, sf_dir).transforms()
    return f.select("pair_id", *[_r(F.get("rotation", F.lit(k))).alias(f"r{k}") for k in range(9)], *[_r(F.get("translation", F.lit(k))).alias(f"t{k}") for k in range(3)], "atom_count")


@query(f"SELECT pair_id, alignment_index, {_q('ca_displacement')} FROM mov WHERE mapped")
def ca_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_analysis(spark, sf_dir).moved().filter("ca_displacement is not null").select("pair_id", "alignment_index", "ca_displacement"))


_SWAPS = ", ".join(f"('{res}', '{a}', '{b}')" for res, t in L.SWAPS.items() for x, y in t.items() for a, b in ((x, y), (y, x)))


_RESIDUE_RMSD_TABLES = f"""
, swp(residue_name, name, other) AS (VALUES {_SWAPS}),
heavy AS (SELECT * FROM atm WHERE NOT regexp_replace(name, '^[0-9]+', '') LIKE 'H%'),
ra AS (SELECT pair_id, alignment_index, name, residue_name, x, y, z FROM cor JOIN heavy ON residue_key = reference_key WHERE mapped),
ta AS (SELECT c.pair_id, alignment_index, name, u00 * x + u01 * y + u02 * z + d0 AS x, u10 * x + u11 * y + u12 * z + d1 AS y, u20 * x + u21 * y + u22 * z + d2 AS z FROM cor c JOIN heavy ON residue_key = target_key JOIN rot USING (pair_id) WHERE mapped),
one AS (SELECT coalesce(ra.pair_id, ta.pair_id) AS pair_id, coalesce(ra.alignment_index, ta.alignment_index) AS alignment_index, coalesce(ra.name, ta.name) AS name, ra.name IS NOT NULL AND ta.name IS NOT NULL AS both_,
  power(ra.x - ta.x, 2) + power(ra.y - ta.y, 2) + power(ra.z - ta.z, 2) AS same, coalesce(power(ra.x - o.x, 2) + power(ra.y - o.y, 2) + power(ra.z - o.z, 2), power(ra.x - ta.x, 2) + power(ra.y - ta.y, 2) + power(ra.z - ta.z, 2)) AS traded,
  swp.other IS NOT NULL AS swaps, coalesce(ra.name, ta.name) IN ('N', 'CA', 'C', 'O') AS bb
  FROM ra FULL JOIN ta ON ra.pair_id = ta.pair_id AND ra.alignment_index = ta.alignment_index AND ra.name = ta.name LEFT JOIN swp ON swp.residue_name = ra.residue_name AND swp.name = ra.name
  LEFT JOIN ta o ON o.pair_id = ra.pair_id AND o.alignment_index = ra.alignment_index AND o.name = swp.other)"""
_RESIDUE_RMSD = f"""SELECT pair_id, alignment_index, {_q(
    "CASE WHEN count(*) FILTER (bb AND both_) = 4 THEN sqrt(avg(same) FILTER (bb)) END AS backbone_rmsd",
    "CASE WHEN bool_and(both_ OR bb) AND count(*) FILTER (NOT bb) > 0 THEN least(sqrt(avg(same) FILTER (NOT bb)), CASE WHEN bool_or(swaps) THEN sqrt(avg(traded) FILTER (NOT bb)) END) END AS sidechain_rmsd",
    "CASE WHEN bool_and(both_) THEN least(sqrt(avg(same)), CASE WHEN bool_or(swaps) THEN sqrt(avg(traded)) END) END AS all_heavy_rmsd",
)} FROM one GROUP BY pair_id, alignment_index"""


@query(f"{_RESIDUE_RMSD_TABLES} {_RESIDUE_RMSD}")
def residue_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    return _rounded(superposition.residue_rmsd(a.correspondence(), a.atoms, a.transforms()))


@query()
def refined_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superposition.refined(_analysis(spark, sf_dir).correspondence()).withColumn("excluded", F.array_join(F.transform("excluded", lambda x: x.cast("string")), ","))


_SUMMARY = f"""SELECT met.pair_id, met.reference_id, met.target_id, {_q('identity', 'similarity', 'coverage', 'target_coverage', 'strict_rmsd')}, aligned_count, n AS mapped_count, mutation_count, insertion_count, deletion_count, conserved_count,
  mapping_mode, decision FROM met LEFT JOIN rot USING (pair_id) LEFT JOIN ({_COUNTS}) USING (pair_id) JOIN ({_DECISION}) USING (pair_id)"""


@query(_SUMMARY)
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_analysis(spark, sf_dir).kept().summary().drop("refined_rmsd", "refined_count", "tm_score"))


@query(f"SELECT target_id, quadrant, {_q('identity', 'strict_rmsd')} FROM (SELECT *, CASE WHEN identity >= 0.5 THEN 'similar' ELSE 'diverged' END || '_sequence_' || CASE WHEN strict_rmsd <= 2.0 THEN 'similar' ELSE 'diverged' END || '_structure' AS quadrant FROM met JOIN rot USING (pair_id))")
def sequence_structure_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(multi.quadrants(_analysis(spark, sf_dir).summary()).select("target_id", "quadrant", "identity", "strict_rmsd"))


# ---- Distances -----------------------------------------------------------------------------------


def _reference_positions(a: Analysis) -> DataFrame:
    return a.moved().filter("reference_key is not null").withColumnsRenamed({"reference_ord": "position_ord", "reference_label": "position", "reference_position": "number"})


@query(f"""SELECT a.pair_id, 'A:' || a.rnum AS pos_i, 'A:' || b.rnum AS pos_j, a.mapped AND b.mapped AS valid, {_q(
    'CASE WHEN a.mapped AND b.mapped THEN sqrt(power(a.rx - b.rx, 2) + power(a.ry - b.ry, 2) + power(a.rz - b.rz, 2)) END AS d_ref', 'CASE WHEN a.mapped AND b.mapped THEN sqrt(power(a.tx - b.tx, 2) + power(a.ty - b.ty, 2) + power(a.tz - b.tz, 2)) END AS d_tgt',
    'CASE WHEN a.mapped AND b.mapped THEN sqrt(power(a.tx - b.tx, 2) + power(a.ty - b.ty, 2) + power(a.tz - b.tz, 2)) - sqrt(power(a.rx - b.rx, 2) + power(a.ry - b.ry, 2) + power(a.rz - b.rz, 2)) END AS delta')}
FROM cor a JOIN cor b ON a.pair_id = b.pair_id AND a.alignment_index < b.alignment_index WHERE a.reference_key IS NOT NULL AND b.reference_key IS NOT NULL""")
def distance_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _analysis(spark, sf_dir).correspondence().filter("reference_key is not null")
    return _rounded(distances.distance_difference(rows.withColumnsRenamed({"reference_ord": "position_ord", "reference_label": "position", "reference_position": "number"})))


@query(f"""SELECT pair_id, position, {_q('vx', 'vy', 'vz', 'magnitude')}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY magnitude DESC, position) AS rank
FROM (SELECT pair_id, 'A:' || rnum AS position, mx - rx AS vx, my - ry AS vy, mz - rz AS vz, ca_displacement AS magnitude FROM mov WHERE mapped AND ca_displacement >= 0.5)) WHERE rank <= 10""")
def displacement_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distances.displacement_vectors(_reference_positions(_analysis(spark, sf_dir)), 0.5, 10)
    return _rounded(out.select("pair_id", "position", "vx", "vy", "vz", "magnitude", "rank"))


_NEAR = "SELECT a.structure_id, a.residue_key AS center, b.residue_key AS member, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM res a JOIN res b USING (structure_id)"


@query(f"SELECT structure_id, center, member, {_q('distance')} FROM ({_NEAR}) WHERE distance <= 5.0")
def neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(distances.neighbourhoods(derived.residues(spark, sf_dir), 5.0))


@query(f"SELECT pair_id, center, {_q('sqrt(avg(ca_displacement * ca_displacement)) AS local_rmsd')}, count(*) AS n FROM mov JOIN ({_NEAR}) ON member = reference_key WHERE mapped AND distance <= 5.0 GROUP BY pair_id, center")
def local_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = derived.residues(spark, sf_dir).filter("is_reference")
    return _rounded(distances.local_rmsd(_analysis(spark, sf_dir).moved(), distances.neighbourhoods(references, 5.0)))


# ---- Many structures -----------------------------------------------------------------------------


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return raw.select(F.col("label").alias("group_id"), F.concat(F.lit("v"), F.col("vec_id")).alias("structure_id"), F.col("vec_id").alias("ord"))


_ALL = f"""
, ava0 AS (SELECT a.label AS group_id, a.structure_id AS reference_id, b.structure_id AS target_id, CASE WHEN a.left_out THEN NULL ELSE coalesce(a.letter, 'X') END AS p, CASE WHEN b.left_out THEN NULL ELSE coalesce(b.letter, 'X') END AS q
  FROM pos a JOIN pos b ON a.label = b.label AND a.i = b.i AND a.vec_id < b.vec_id),
ava1 AS (SELECT ava0.*, score, p <> 'X' AS pc, q <> 'X' AS qc FROM ava0 LEFT JOIN sub ON a = p AND b = q),
ava2 AS (SELECT group_id, reference_id, target_id, count(*) FILTER (pc AND qc) AS al, count(*) FILTER (pc AND qc AND p = q) AS sm, count(*) FILTER (pc AND qc AND score > 0) AS lk, count(*) FILTER (pc) AS np FROM ava1 GROUP BY ALL),
ava AS (SELECT group_id, reference_id, target_id, coalesce(sm / nullif(al, 0), 0.0) AS identity, coalesce(lk / nullif(al, 0), 0.0) AS similarity, coalesce(al / nullif(np, 0), 0.0) AS coverage, al AS aligned_count FROM ava2)
"""


@query(f"{_ALL} SELECT group_id, metric, left_id, right_id, {_q('value')}, 'fraction' AS unit FROM (UNPIVOT (SELECT group_id, least(reference_id, target_id) AS left_id, greatest(reference_id, target_id) AS right_id, identity, similarity, coverage FROM ava) ON identity, similarity, coverage INTO NAME metric VALUE value)")
def all_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi.row_matrices(_structures(spark, sf_dir), derived.rows_of_structures(spark, sf_dir), places=PLACES)


@query(f"""{_ALL}, ids AS (SELECT DISTINCT label AS group_id, structure_id FROM pos)
SELECT a.group_id, 'identity' AS metric, a.structure_id AS row_id, b.structure_id AS column_id, {_q('identity AS value')}, CASE WHEN identity IS NULL THEN '—' ELSE format('{{:.3f}}', identity) END AS text, CASE WHEN a.structure_id = b.structure_id THEN 'diagonal' ELSE 'value' END AS cell_status
FROM ids a JOIN ids b USING (group_id) LEFT JOIN ava v ON v.group_id = a.group_id AND least(a.structure_id, b.structure_id) = least(v.reference_id, v.target_id) AND greatest(a.structure_id, b.structure_id) = greatest(v.reference_id, v.target_id)""")
def pairwise_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi.row_heatmap(_structures(spark, sf_dir), derived.rows_of_structures(spark, sf_dir), ["identity"], PLACES)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.residues(spark, sf_dir).filter("is_reference").select(F.col("structure_id").alias("reference_id"), F.col("residue_ord").alias("reference_ord"), "residue_key", F.col("auth_seq_id").try_cast("int").alias("reference_position"))


_POSITIONS = """
, tg AS (SELECT reference_id, count(DISTINCT target_id) AS nt FROM cor GROUP BY reference_id),
refp AS (SELECT structure_id AS reference_id, residue_key, i, num FROM res WHERE is_reference),
pp0 AS (SELECT reference_id, coalesce(CASE WHEN reference_key IS NOT NULL THEN reference_key END, target_id || '#' || alignment_index) AS slot, reference_key, target_id, alignment_index, target_key, CASE WHEN mapped THEN ca_displacement END AS d,
  (SELECT min(i) FROM refp r WHERE r.reference_id = mov.reference_id AND r.i >= mov.pi) AS anchor FROM (SELECT mov.*, p.i AS pi FROM mov JOIN pos p ON p.structure_id = split_part(coalesce(reference_key, target_key), '/', 1) AND p.num = split_part(coalesce(reference_key, target_key), '/', 3)) mov),
pp1 AS (SELECT reference_id, reference_key, coalesce(anchor, 99) AS anchor, CASE WHEN reference_key IS NULL THEN 0 ELSE 1 END AS is_ref, CASE WHEN reference_key IS NULL THEN target_id ELSE '' END AS of_, CASE WHEN reference_key IS NULL THEN alignment_index ELSE 0 END AS nth, target_key, d FROM pp0
  UNION ALL SELECT reference_id, residue_key, i, 1, '', 0, NULL, NULL FROM refp),
pp AS (SELECT reference_id, reference_key, anchor, is_ref, of_, nth, count(target_key) AS mapped_count, count(d) AS nd, sum(d) AS s, sum(d * d) AS q FROM pp1 GROUP BY ALL),
mpos AS (SELECT p.reference_id, CAST(row_number() OVER (PARTITION BY p.reference_id ORDER BY anchor, is_ref, of_, nth) - 1 AS INTEGER) AS position_index, reference_key, mapped_count, (mapped_count + is_ref) / (nt + 1) AS coverage,
  CASE WHEN is_ref = 1 AND nd > 0 THEN sqrt(greatest(q / (nd + 1) - power(s / (nd + 1), 2), 0)) END AS variability FROM pp p JOIN tg USING (reference_id))
"""


@query(f"{_POSITIONS} SELECT reference_id, position_index, reference_key, mapped_count, {_q('coverage', 'variability')} FROM mpos")
def multi_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(multi.positions(_analysis(spark, sf_dir).moved(), _references(spark, sf_dir)))


@query(f"SELECT reference_id, reference_key, count(*) AS n, {_q('quantile_cont(ca_displacement, 0.25) AS q1', 'quantile_cont(ca_displacement, 0.5) AS median', 'quantile_cont(ca_displacement, 0.75) AS q3', 'quantile_cont(ca_displacement, 0.75) - quantile_cont(ca_displacement, 0.25) AS iqr')} FROM mov WHERE mapped GROUP BY reference_id, reference_key")
def deviation_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(multi.deviation_envelope(_analysis(spark, sf_dir).moved()))


# ---- Multiple alignments -------------------------------------------------------------------------


def _msa_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.rows_of_structures(spark, sf_dir).join(_structures(spark, sf_dir), "structure_id")
    return msa.cells(rows.select(F.col("group_id").cast("string").alias("alignment_id"), F.col("ord").alias("seq_ord"), "structure_id", "row"))


def _msa_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.residues(spark, sf_dir).filter("is_reference")
    return own.select(F.col("label").cast("string").alias("alignment_id"), F.col("residue_ord").alias("seq_index"), F.concat("chain_id", F.lit(":"), "auth_seq_id", F.coalesce("insertion_code", F.lit(""))).alias("label"), "residue_key")


_MSA = """
, mc AS (SELECT CAST(label AS VARCHAR) AS alignment_id, CAST(i AS INTEGER) AS column_index, structure_id, is_reference, CASE WHEN left_out THEN '-' ELSE coalesce(letter, 'X') END AS c, num, structure_id || '/A/' || num AS key FROM pos),
ml AS (SELECT alignment_id, column_index, c, count(*) AS n FROM mc WHERE c NOT IN ('-', 'X') GROUP BY ALL),
mf AS (SELECT *, n / sum(n) OVER (PARTITION BY alignment_id, column_index) AS f, sum(n) OVER (PARTITION BY alignment_id, column_index) AS canonical FROM ml),
me AS (SELECT alignment_id, column_index, CASE WHEN any_value(canonical) >= 2 THEN 0.0 - sum(f * log2(f)) END AS entropy_bits FROM mf GROUP BY ALL),
mcon AS (SELECT alignment_id, column_index, count(*) FILTER (c <> '-') AS non_gap_count, avg(CASE WHEN c = '-' THEN 1.0 ELSE 0.0 END) AS gap_fraction, avg(CASE WHEN c = 'X' THEN 1.0 ELSE 0.0 END) AS ambiguous_fraction, any_value(entropy_bits) AS entropy_bits
  FROM mc LEFT JOIN me USING (alignment_id, column_index) GROUP BY ALL),
mlab0 AS (SELECT alignment_id, column_index, CASE WHEN c <> '-' THEN 'A:' || num END AS own, CASE WHEN c <> '-' THEN key END AS reference_key FROM mc WHERE is_reference),
mlab1 AS (SELECT *, count(own) OVER w AS island, last_value(own IGNORE NULLS) OVER w AS prev FROM mlab0 WINDOW w AS (PARTITION BY alignment_id ORDER BY column_index ROWS UNBOUNDED PRECEDING)),
mlab AS (SELECT alignment_id, column_index, reference_key, coalesce(own, coalesce(prev, 'N') || '+' || (row_number() OVER (PARTITION BY alignment_id, island ORDER BY column_index) - CASE WHEN island = 0 THEN 0 ELSE 1 END)) AS reference_label FROM mlab1)
"""


@query(f"{_MSA} SELECT alignment_id, column_index, reference_label, reference_key, non_gap_count, {_q('gap_fraction', 'ambiguous_fraction', 'entropy_bits', '1.0 - entropy_bits / log2(20) AS conservation')} FROM mlab JOIN mcon USING (alignment_id, column_index)")
def msa_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(msa.columns(_msa_cells(spark, sf_dir), _msa_labels(spark, sf_dir)))


@query(f"{_MSA} SELECT alignment_id, column_index, c AS character, n, canonical, {_q('f AS frequency')} FROM (SELECT * REPLACE (CAST(canonical AS BIGINT) AS canonical) FROM mf)")
def aa_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(msa.letter_counts(_msa_cells(spark, sf_dir)))


@query(f"{_MSA} SELECT alignment_id, column_index, {', '.join(_q(f'''coalesce(max(f) FILTER (c = '{x}'), 0.0) AS "{x}"''').replace(f'AS "{x}"', f'AS {x}') for x in L.CANONICAL)} FROM mf GROUP BY alignment_id, column_index")
def aa_frequency_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(msa.frequency_sheet(_msa_cells(spark, sf_dir)))


@query(f"{_MSA} SELECT alignment_id, column_index, c AS character, {_q('f * (log2(20) - entropy_bits) AS height')} FROM mf JOIN me USING (alignment_id, column_index) WHERE entropy_bits IS NOT NULL")
def sequence_logo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(msa.logo(_msa_cells(spark, sf_dir)))


@query(f"{_MSA} SELECT alignment_id, column_index, reference_label, structure_id, c AS character FROM mc JOIN mlab USING (alignment_id, column_index) WHERE c <> '-' AND mlab.reference_key IS NULL")
def insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _msa_cells(spark, sf_dir)
    return msa.insertions(cells, msa.column_labels(cells, _msa_labels(spark, sf_dir)))


@query(f"{_MSA} SELECT alignment_id, column_index + 1 AS x, {_q('1.0 - entropy_bits / log2(20) AS y')}, reference_label AS label FROM mlab JOIN mcon USING (alignment_id, column_index)")
def chart_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(charts.msa_profile(msa.columns(_msa_cells(spark, sf_dir), _msa_labels(spark, sf_dir))))


@query()
def msa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.rows_of_structures(spark, sf_dir).join(_structures(spark, sf_dir), "structure_id")
    own = rows.select(F.col("group_id").cast("string").alias("alignment_id"), F.col("ord").cast("int").alias("seq_ord"), "structure_id", F.translate("row", "-", "").alias("sequence"))
    return msa.align(own).select("alignment_id", "seq_ord", "structure_id", "row")


@query()
def global_alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace(F.upper("p_name"), f"[^{L.CANONICAL}]", "")
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(letters.alias("structure_id")).distinct().withColumn("group_id", F.lit(0)).withColumn("ord", F.col("structure_id"))
    pairs = multi.unordered_pairs(names).withColumns({"reference_sequence": F.col("reference_id"), "target_sequence": F.col("target_id")})
    return align_pairs(pairs)


# ---- Interactions --------------------------------------------------------------------------------




def _names(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_RING_ROWS = ", ".join(f"('{res}', {grp}, {i}, '{name}', {len(names)})" for (res, grp), names in L.RINGS.items() for i, name in enumerate(names))
_CATION_ROWS = ", ".join(f"('{res}', {i}, '{name}', {len(names)})" for res, names in L.CATION_GROUPS.items() for i, name in enumerate(names))
_CONTACTS = f"""
, greasy AS (SELECT DISTINCT structure_id, residue_key FROM atm WHERE residue_name IN {_names(L.HYDROPHOBIC)} AND name NOT IN ('N', 'CA', 'C', 'O', 'OXT') AND element IN ('C', 'S')),
at1 AS MATERIALIZED (SELECT atm.*, CAST(floor(x / 4.5) AS BIGINT) AS cell, g.residue_key IS NOT NULL AS gr, name IN {_names(L.DONORS)} AND element IN ('N', 'O', 'S') AS dn, name IN {_names(L.ACCEPTORS)} AND element IN ('N', 'O', 'S') AS ac,
  residue_name IN {_names(L.CATIONIC)} AS ct, residue_name IN {_names(L.ACIDIC)} AS acid FROM atm LEFT JOIN greasy g USING (structure_id, residue_key)),
at2 AS (SELECT at1.* EXCLUDE (cell), cell + d AS cell FROM at1, (VALUES (-1), (0), (1)) s(d)),
hp0 AS (SELECT a.structure_id, a.residue_key AS residue_a, b.residue_key AS residue_b, a.name AS atom_a, b.name AS atom_b, a.atom_ord AS oa, b.atom_ord AS ob, {_DIST} AS distance, (a.dn AND b.ac) OR (b.dn AND a.ac) AS da, a.gr AND b.gr AS gg,
  (a.ct AND b.acid) OR (a.acid AND b.ct) AS br FROM at1 a JOIN at2 b ON a.structure_id = b.structure_id AND a.cell = b.cell AND a.residue_ord < b.residue_ord AND abs(a.x - b.x) <= 4.5 AND abs(a.y - b.y) <= 4.5),
hp1 AS (SELECT *, CASE WHEN da AND distance <= 3.5 THEN 'hbond_geometric' WHEN gg AND distance <= 4.5 THEN 'hydrophobic' END AS kind, br AND distance <= 4.0 AS bridge FROM hp0),
hp2 AS (SELECT *, row_number() OVER (PARTITION BY structure_id, residue_a, residue_b ORDER BY CASE WHEN kind IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN kind IS NOT NULL THEN oa END, CASE WHEN kind IS NOT NULL THEN ob END, distance, oa, ob) AS rn FROM hp1 WHERE kind IS NOT NULL OR bridge),
heavyc AS (SELECT structure_id, coalesce(kind, 'salt_bridge') AS type, residue_a, residue_b, atom_a, atom_b, distance, CAST(NULL AS DOUBLE) AS angle, CAST(NULL AS VARCHAR) AS external_id, 'heavy_atom_geometry' AS evidence_mode FROM hp2 WHERE rn = 1),
rt(residue_name, grp, nth, name, size) AS (VALUES {_RING_ROWS}),
rm AS (SELECT structure_id, residue_key, residue_ord, grp, nth, name, size, x, y, z FROM atm JOIN rt USING (residue_name, name)),
rc AS (SELECT structure_id, residue_key, residue_ord, grp, avg(x) AS x, avg(y) AS y, avg(z) AS z, min_by(name, nth) AS name FROM rm GROUP BY structure_id, residue_key, residue_ord, grp, size HAVING count(*) = size),
rx0 AS (SELECT c.*, a.nth AS na, b.nth AS nb, a.x - c.x AS ax, a.y - c.y AS ay, a.z - c.z AS az, b.x - c.x AS bx, b.y - c.y AS by_, b.z - c.z AS bz FROM rc c JOIN rm a ON a.structure_id = c.structure_id AND a.residue_key = c.residue_key AND a.grp = c.grp JOIN rm b ON b.structure_id = c.structure_id AND b.residue_key = c.residue_key AND b.grp = c.grp AND a.nth < b.nth),
rx1 AS (SELECT *, ay * bz - az * by_ AS vx, az * bx - ax * bz AS vy, ax * by_ - ay * bx AS vz FROM rx0),
rx2 AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS len FROM rx1),
rg AS (SELECT * FROM rx2 QUALIFY row_number() OVER (PARTITION BY structure_id, residue_key, grp ORDER BY round(len, 9) DESC, na, nb) = 1),
pi0 AS (SELECT a.structure_id, a.residue_key AS residue_a, b.residue_key AS residue_b, a.name AS atom_a, b.name AS atom_b, a.grp AS ga, b.grp AS gb, {_DIST} AS distance, degrees(acos(greatest(-1, least(1, (a.vx * b.vx + a.vy * b.vy + a.vz * b.vz) / (a.len * b.len))))) AS full_
  FROM rg a JOIN rg b ON a.structure_id = b.structure_id AND a.residue_ord < b.residue_ord),
pis AS (SELECT structure_id, 'pi_stacking' AS type, residue_a, residue_b, atom_a, atom_b, distance, least(full_, 180 - full_) AS angle, CAST(NULL AS VARCHAR) AS external_id, 'aromatic_ring_geometry' AS evidence_mode FROM pi0
  WHERE distance <= 5.5 AND (least(full_, 180 - full_) <= 30 OR full_ BETWEEN 60 AND 120) QUALIFY row_number() OVER (PARTITION BY structure_id, residue_a, residue_b ORDER BY distance, least(full_, 180 - full_), ga, gb) = 1),
cg(residue_name, nth, name, size) AS (VALUES {_CATION_ROWS}),
cc AS (SELECT structure_id, residue_key, residue_ord, avg(x) AS x, avg(y) AS y, avg(z) AS z, min_by(name, nth) AS name FROM atm JOIN cg USING (residue_name, name) GROUP BY structure_id, residue_key, residue_ord, size HAVING count(*) = size),
cp0 AS (SELECT a.structure_id, a.residue_key AS rk, b.residue_key AS ck, a.residue_ord AS ro, b.residue_ord AS co, a.name AS ra, b.name AS ca, a.grp, {_DIST} AS distance,
  degrees(acos(greatest(-1, least(1, (a.vx * (b.x - a.x) + a.vy * (b.y - a.y) + a.vz * (b.z - a.z)) / (a.len * {_DIST}))))) AS full_, a.residue_key IN (SELECT residue_key FROM atm WHERE residue_name IN {_names(L.CATIONIC)}) AS ring_cation
  FROM rg a JOIN cc b ON a.structure_id = b.structure_id AND a.residue_ord <> b.residue_ord AND {_DIST} > 1e-12),
cps AS (SELECT structure_id, 'cation_pi' AS type, CASE WHEN co < ro THEN ck ELSE rk END AS residue_a, CASE WHEN co < ro THEN rk ELSE ck END AS residue_b, CASE WHEN co < ro THEN ca ELSE ra END AS atom_a, CASE WHEN co < ro THEN ra ELSE ca END AS atom_b,
  distance, least(full_, 180 - full_) AS angle, CAST(NULL AS VARCHAR) AS external_id, 'cation_ring_geometry' AS evidence_mode FROM cp0 WHERE distance <= 6 AND least(full_, 180 - full_) <= 45 AND (co < ro OR NOT ring_cation)
  QUALIFY row_number() OVER (PARTITION BY structure_id, rk, ck ORDER BY distance, least(full_, 180 - full_), grp) = 1),
mts AS (SELECT a.structure_id, 'metal_contact' AS type, a.residue_key AS residue_a, b.residue_key AS residue_b, a.name AS atom_a, b.name AS atom_b, {_DIST} AS distance, CAST(NULL AS DOUBLE) AS angle, a.name AS external_id, 'heavy_atom_geometry' AS evidence_mode
  FROM atm a JOIN atm b ON a.structure_id = b.structure_id AND a.residue_key <> b.residue_key WHERE a.element IN {_names(L.METALS)} AND {_DIST} <= 3.0 QUALIFY row_number() OVER (PARTITION BY a.structure_id, a.residue_key, a.atom_ord, b.residue_key ORDER BY b.atom_ord) = 1),
contacts AS MATERIALIZED (SELECT * FROM heavyc UNION ALL SELECT * FROM pis UNION ALL SELECT * FROM cps UNION ALL SELECT * FROM mts)
"""
_CONTACT_COLUMNS = f"structure_id, type, residue_a, residue_b, atom_a, atom_b, {_q('distance', 'angle')}, external_id, evidence_mode"


@query(f"{_CONTACTS} SELECT {_CONTACT_COLUMNS} FROM heavyc")
def heavy_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(interactions.heavy_contacts(derived.atoms(spark, sf_dir)))


@query(f"{_CONTACTS} SELECT {_CONTACT_COLUMNS} FROM heavyc WHERE type = 'salt_bridge'")
def salt_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(interactions.heavy_contacts(derived.atoms(spark, sf_dir)).filter("type = 'salt_bridge'"))


@query(f"{_CONTACTS} SELECT {_CONTACT_COLUMNS} FROM pis")
def pi_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(interactions.pi_stacking(derived.atoms(spark, sf_dir)))


@query(f"{_CONTACTS} SELECT {_CONTACT_COLUMNS} FROM cps")
def cation_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(interactions.cation_pi(derived.atoms(spark, sf_dir)))


@query(f"{_CONTACTS} SELECT {_CONTACT_COLUMNS} FROM mts")
def metal_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(interactions.metal_contacts(derived.atoms(spark, sf_dir)))


def _mapping(a: Analysis) -> DataFrame:
    """Positions of the mapped columns; a position is the reference's label."""
    rows = a.correspondence().filter("reference_key is not null and target_key is not null")
    return rows.select("pair_id", "reference_id", "target_id", F.col("reference_label").alias("position"), "reference_key", "target_key")


def _kept_mapping(a: Analysis) -> DataFrame:
    """The mapping alone is written, once; atoms follow from their residues without a shuffle and would be the largest table."""
    shared_dir(a.alignments.sparkSession)
    return _mapping(a).checkpoint()


_DIFF = f"""{_CONTACTS}
, dm AS MATERIALIZED (SELECT pair_id, reference_id, target_id, 'A:' || rnum AS position, reference_key, target_key FROM cor WHERE mapped),
dr AS (SELECT p.pair_id, c.type, a.position AS pa, b.position AS pb, c.external_id, c.distance, c.residue_a, c.residue_b, c.atom_a, c.atom_b FROM prs p JOIN contacts c ON c.structure_id = p.reference_id
  LEFT JOIN dm a ON a.pair_id = p.pair_id AND a.reference_key = c.residue_a LEFT JOIN dm b ON b.pair_id = p.pair_id AND b.reference_key = c.residue_b),
dt AS (SELECT p.pair_id, c.type, a.position AS pa, b.position AS pb, c.external_id, c.distance, c.residue_a, c.residue_b, c.atom_a, c.atom_b FROM prs p JOIN contacts c ON c.structure_id = p.target_id
  LEFT JOIN dm a ON a.pair_id = p.pair_id AND a.target_key = c.residue_a LEFT JOIN dm b ON b.pair_id = p.pair_id AND b.target_key = c.residue_b),
dr1 AS (SELECT pair_id, type, least(pa, pb) AS pos_a, greatest(pa, pb) AS pos_b, coalesce(external_id, '') AS e, distance FROM dr WHERE pa IS NOT NULL AND pb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id, type, least(pa, pb), greatest(pa, pb), external_id ORDER BY residue_a DESC, residue_b DESC, atom_a DESC, atom_b DESC) = 1),
dt1 AS (SELECT pair_id, type, least(pa, pb) AS pos_a, greatest(pa, pb) AS pos_b, coalesce(external_id, '') AS e, distance FROM dt WHERE pa IS NOT NULL AND pb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id, type, least(pa, pb), greatest(pa, pb), external_id ORDER BY residue_a DESC, residue_b DESC, atom_a DESC, atom_b DESC) = 1),
diff AS (SELECT pair_id, type, pos_a, pos_b, nullif(e, '') AS external_id, CASE WHEN dr1.distance IS NULL THEN 'gained' WHEN dt1.distance IS NULL THEN 'lost' ELSE 'conserved' END AS change, dr1.distance AS reference_distance, dt1.distance AS target_distance
  FROM dr1 FULL JOIN dt1 USING (pair_id, type, pos_a, pos_b, e)
  UNION ALL SELECT pair_id, type, 'unmapped', NULL, external_id, 'target_only_unmapped', NULL, distance FROM dt WHERE pa IS NULL OR pb IS NULL)
"""


@query(f"{_DIFF} SELECT pair_id, type, pos_a, pos_b, external_id, change, {_q('reference_distance', 'target_distance')} FROM diff")
def interaction_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    return _rounded(interactions.compare(interactions.detect(a.atoms), _kept_mapping(a)))


# ---- Sites ---------------------------------------------------------------------------------------

#: Key residues of a derived reference: positions 2, 4, 9 and one that isn't there.
_KEYS = ("3", "5", "9", "99")


def _key_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = derived.residues(spark, sf_dir).filter("is_reference").select("structure_id").distinct()
    keys = F.array(*[F.concat("structure_id", F.lit(f"/A/{k}")) for k in _KEYS])
    return references.select(F.concat(F.lit("key:"), "structure_id").alias("site_id"), keys.alias("keys"))


def _key_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.members_by_keys(_key_sites(spark, sf_dir), derived.residues(spark, sf_dir))


def _around(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Sites of 6 Angstrom around the residue of number 9, or around the ligand, of each reference; members are chain residues."""
    atoms = derived.atoms(spark, sf_dir)
    references = derived.residues(spark, sf_dir).filter("is_reference").select("structure_id").distinct()
    own = atoms.join(F.broadcast(references), "structure_id")
    center = own.filter("residue_name = 'LIG'") if kind == "ligand" else own.filter(F.col("residue_key") == F.concat("structure_id", F.lit("/A/9")))
    centers = center.select(F.concat(F.lit(f"{kind}:"), "structure_id").alias("site_id"), "structure_id", "x", "y", "z")
    return sites.members_by_radius(centers, own.filter("residue_ord < 100"), 6.0)


_REFS = "refs AS (SELECT DISTINCT structure_id FROM pos WHERE is_reference)"
_KEY_SITES = f", {_REFS}, ks AS (SELECT 'key:' || structure_id AS site_id, structure_id, residue_key, CAST(k.o AS INTEGER) AS site_ord FROM refs JOIN res USING (structure_id) JOIN (VALUES {', '.join(f'({i}, {chr(39)}{k}{chr(39)})' for i, k in enumerate(_KEYS))}) k(o, num) USING (num))"


def _sphere(kind: str) -> str:
    center = "a.residue_name = 'LIG'" if kind == "ligand" else "a.residue_key = a.structure_id || '/A/9'"
    return f", {_REFS}, sp AS (SELECT DISTINCT '{kind}:' || a.structure_id AS site_id, a.structure_id, b.residue_key, CAST(b.residue_ord AS INTEGER) AS site_ord FROM refs JOIN atm a USING (structure_id) JOIN atm b ON a.structure_id = b.structure_id AND b.residue_ord < 100 WHERE {center} AND {_DIST} <= 6.0)"


@query(f"{_KEY_SITES} SELECT site_id, structure_id, residue_key, site_ord FROM ks")
def site_members_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_members(spark, sf_dir)


@query(f"{_sphere('radius')} SELECT * FROM sp")
def site_members_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, "radius")


@query(f"{_sphere('ligand')} SELECT * FROM sp")
def site_members_ligand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, "ligand")


def _site_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    return sites.metrics(_around(spark, sf_dir, "radius"), a.moved(), a.atoms)


@query(f"""{_sphere('radius')}, sz AS (SELECT site_id, structure_id AS reference_id, count(*) AS selected FROM sp GROUP BY ALL),
sm AS (SELECT site_id, pair_id, count(*) AS mapped_count, sqrt(avg(power(mx - rx, 2) + power(my - ry, 2) + power(mz - rz, 2))) AS global_rmsd, sqrt(var_pop(mx - rx) + var_pop(my - ry) + var_pop(mz - rz)) AS site_fitted_rmsd,
  sqrt(power(avg(mx - rx), 2) + power(avg(my - ry), 2) + power(avg(mz - rz), 2)) AS centroid_displacement, sqrt(var_pop(rx) + var_pop(ry) + var_pop(rz)) AS rg, avg(CASE WHEN tname IN {_names(L.SITE_POLAR)} THEN 1.0 ELSE 0.0 END) AS polar_fraction,
  avg(CASE WHEN tname IN {_names(L.SITE_CHARGED)} THEN 1.0 ELSE 0.0 END) AS charged_fraction FROM sp JOIN mov ON reference_key = residue_key WHERE mapped GROUP BY site_id, pair_id)
SELECT sz.site_id, prs.pair_id, prs.target_id, coalesce(mapped_count, 0) AS mapped_count, {_q('coalesce(mapped_count, 0) / selected AS coverage', 'global_rmsd', 'site_fitted_rmsd', 'centroid_displacement', 'rg', 'polar_fraction', 'charged_fraction')}
FROM sz JOIN prs USING (reference_id) LEFT JOIN sm ON sm.site_id = sz.site_id AND sm.pair_id = prs.pair_id""")
def site_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_site_metrics(spark, sf_dir).drop("hull_volume", "sasa"))


@query()
def site_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_metrics(spark, sf_dir).select("site_id", "pair_id", "hull_volume")


@query(f"""{_DIFF}{_sphere('radius')}, smem AS (SELECT DISTINCT site_id, pair_id, 'A:' || rnum AS position FROM sp JOIN cor ON reference_key = residue_key WHERE mapped),
td AS (SELECT DISTINCT site_id, d.pair_id, type, pos_a, pos_b, external_id, change FROM diff d JOIN smem m ON m.pair_id = d.pair_id AND (m.position = d.pos_a OR m.position = d.pos_b))
SELECT site_id, pair_id, type, count(*) FILTER (change IN ('conserved', 'lost')) AS reference_count, count(*) FILTER (change IN ('conserved', 'gained')) AS target_count, count(*) FILTER (change = 'conserved') AS conserved_count,
  count(*) FILTER (change = 'gained') AS gained_count, count(*) FILTER (change = 'lost') AS lost_count FROM td GROUP BY ALL""")
def interaction_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    mapping = _kept_mapping(a)
    members = _around(spark, sf_dir, "radius").select("site_id", F.col("residue_key").alias("reference_key")).join(mapping.select("pair_id", "reference_key", "position"), "reference_key")
    return interactions.fingerprint(interactions.compare(interactions.detect(a.atoms), mapping), members.select("site_id", "pair_id", "position"))


# ---- Evidence, charts, filters -------------------------------------------------------------------


@query(f"""{_KEY_SITES} SELECT pair_id, reference_key, c.kind, {_q('ca_displacement')}, CASE WHEN c.kind IS NULL THEN 0 ELSE 1 END + CASE WHEN ca_displacement IS NULL THEN 0 ELSE 1 END + CASE WHEN ks.site_id IS NULL THEN 0 ELSE 1 END AS source_count,
  CASE WHEN c.kind IS NULL AND ca_displacement IS NULL AND ks.site_id IS NULL THEN 'unavailable' ELSE 'partial' END AS overall_status,
  'Reference ' || rname || ' · target ' || target_id || ' · evidence ' || CASE WHEN c.kind IS NULL AND ca_displacement IS NULL AND ks.site_id IS NULL THEN 'unavailable' ELSE 'partial' END AS text
FROM mov JOIN ev c USING (pair_id, alignment_index) LEFT JOIN ks ON ks.residue_key = reference_key WHERE reference_key IS NOT NULL""")
def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    rows = a.moved().filter("reference_key is not null")
    own = rows.select("pair_id", "alignment_index", "reference_key", "target_id", "reference_name", "ca_displacement")
    sequence = own.join(a.mutations().select("pair_id", "alignment_index", "kind", "notation"), ["pair_id", "alignment_index"]).select("pair_id", "reference_key", "kind", "notation")
    structure = own.filter("ca_displacement is not null").select("pair_id", "reference_key", "ca_displacement")
    site = own.join(_key_members(spark, sf_dir).select("site_id", F.col("residue_key").alias("reference_key")), "reference_key").select("pair_id", "reference_key", "site_id")
    out = evidence.cards(own.select("pair_id", "target_id", "reference_key", "reference_name"), sequence, structure, None, site)
    return _rounded(out.select("pair_id", "reference_key", "sequence.kind", "structure.ca_displacement", "source_count", "overall_status", "text"))


_NUMBER = "try_cast(regexp_replace(rnum, '[A-Z]$', '') AS INTEGER)"


@query(f"SELECT pair_id, target_id, CAST({_NUMBER} AS DOUBLE) AS x, {_q('CASE WHEN mapped THEN ca_displacement END AS y')}, 'A:' || rnum AS label, alignment_index FROM mov WHERE reference_key IS NOT NULL")
def chart_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(charts.deviation_profile(_analysis(spark, sf_dir).moved()))


@query(f"""SELECT pair_id, target_id, 'A:' || rnum AS column_label, CASE WHEN status = 'conserved' THEN 1.0 ELSE 0.0 END + CAST(0 AS DOUBLE) AS value, CASE WHEN target_aa IS NULL THEN reference_aa || '-' ELSE reference_aa || regexp_replace(rnum, '[A-Z]$', '') || target_aa END AS text,
  status, alignment_index, CASE WHEN target_key IS NULL THEN '—' ELSE 'A:' || tnum END AS target_residue FROM cor WHERE reference_key IS NOT NULL""")
def chart_mutation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.mutation_matrix(_analysis(spark, sf_dir).correspondence())


@query(f"SELECT target_id, {_q('identity * 100.0 AS x', 'strict_rmsd AS y')} FROM met JOIN rot USING (pair_id)")
def chart_sequence_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(charts.sequence_structure(_analysis(spark, sf_dir).summary()))


@query(f"""{_POSITIONS} SELECT reference_id, position_index, CAST(coalesce(try_cast(regexp_replace(split_part(reference_key, '/', 3), '[A-Z]$', '') AS INTEGER), position_index + 1) AS DOUBLE) AS x, series, {_q('y')}
FROM (SELECT *, 'variability' AS series, variability AS y FROM mpos UNION ALL SELECT *, 'coverage (%)', coverage * 100.0 FROM mpos)""")
def chart_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = _references(spark, sf_dir)
    positions = multi.positions(_analysis(spark, sf_dir).moved(), references)
    numbered = positions.join(references.select(F.col("residue_key").alias("reference_key"), "reference_position"), "reference_key", "left")
    return _rounded(charts.conservation_profile(numbered))


@query(f"""{_KEY_SITES} SELECT p.pair_id, p.target_id, site_ord AS key_ord, CAST(try_cast(split_part(residue_key, '/', 3) AS INTEGER) AS DOUBLE) AS x, {_q('m.d AS y')}, 'A:' || split_part(residue_key, '/', 3) AS label
FROM prs p JOIN ks ON ks.structure_id = p.reference_id LEFT JOIN (SELECT pair_id, reference_key, CASE WHEN mapped THEN ca_displacement END AS d FROM mov) m ON m.pair_id = p.pair_id AND m.reference_key = residue_key""")
def chart_key_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    numbers = derived.residues(spark, sf_dir).select(F.col("residue_key").alias("reference_key"), F.col("auth_seq_id").try_cast("int").alias("reference_position"), F.concat("chain_id", F.lit(":"), "auth_seq_id", F.coalesce("insertion_code", F.lit(""))).alias("reference_label"))
    keys = _key_members(spark, sf_dir).select(F.col("structure_id").alias("reference_id"), F.col("residue_key").alias("reference_key"), F.col("site_ord").alias("key_ord")).join(numbers, "reference_key")
    return _rounded(charts.key_residues(a.moved(), keys))


@query(f"SELECT pair_id, {_q('greatest(abs(min(dd)), abs(max(dd))) AS bound')} FROM (SELECT a.pair_id, sqrt(power(a.tx - b.tx, 2) + power(a.ty - b.ty, 2) + power(a.tz - b.tz, 2)) - sqrt(power(a.rx - b.rx, 2) + power(a.ry - b.ry, 2) + power(a.rz - b.rz, 2)) AS dd FROM cor a JOIN cor b ON a.pair_id = b.pair_id AND a.alignment_index < b.alignment_index WHERE a.mapped AND b.mapped) GROUP BY pair_id")
def symmetric_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _analysis(spark, sf_dir).correspondence().filter("reference_key is not null and target_key is not null")
    half = distances.distance_difference(rows.withColumnsRenamed({"reference_ord": "position_ord", "reference_label": "position", "reference_position": "number"}))
    return _rounded(charts.symmetric_bound(half, "delta", ["pair_id"]))


@query("""SELECT pair_id, alignment_index, CASE WHEN d IS NULL THEN 'slate' WHEN hi = lo THEN 'yellow' WHEN (d - lo) / (hi - lo) < 0.34 THEN 'blue' WHEN (d - lo) / (hi - lo) < 0.67 THEN 'yellow' ELSE 'red' END AS color
FROM (SELECT *, min(d) OVER (PARTITION BY pair_id) AS lo, max(d) OVER (PARTITION BY pair_id) AS hi FROM (SELECT pair_id, alignment_index, CASE WHEN mapped THEN ca_displacement END AS d FROM mov))""")
def color_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.color_bins(_analysis(spark, sf_dir).moved(), "ca_displacement", ["pair_id"]).select("pair_id", "alignment_index", "color")


@query(f"""{_KEY_SITES}, hl AS (SELECT status, ks.site_id IS NOT NULL AS is_key, mapped AND ca_displacement > 2.0 AS is_outlier, mapped FROM mov LEFT JOIN ks ON ks.residue_key = reference_key)
SELECT 'all' AS filter, count(*) AS n FROM hl UNION ALL SELECT 'mutations', count(*) FROM hl WHERE status <> 'conserved' UNION ALL SELECT 'conserved', count(*) FROM hl WHERE status = 'conserved' UNION ALL SELECT 'key', count(*) FROM hl WHERE is_key
UNION ALL SELECT 'mutated_key', count(*) FROM hl WHERE is_key AND status <> 'conserved' UNION ALL SELECT 'outliers', count(*) FROM hl WHERE is_outlier UNION ALL SELECT 'insertions_deletions', count(*) FROM hl WHERE status IN ('insertion', 'deletion')
UNION ALL SELECT 'displacement', count(*) FROM hl WHERE mapped""")
def highlight_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.broadcast(_key_members(spark, sf_dir).select(F.col("residue_key").alias("reference_key"), F.lit(True).alias("is_key")))
    rows = correspondence.validate(_analysis(spark, sf_dir).moved()).join(keys, "reference_key", "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))
    counts = rows.agg(*[F.count_if(F.expr(p)).alias(name) for name, p in correspondence.HIGHLIGHTS.items()])
    return counts.unpivot([], list(correspondence.HIGHLIGHTS), "filter", "n")
