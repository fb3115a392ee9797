"""Single operators: kernels against plain versions, and behaviour under motion, swaps and gaps."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldframe.functions import lookups as L
from foldframe.operators import alignment, correspondence, msa, multi, mutations, sites, spatial, superposition
from foldframe.plans.engine import Analysis
from foldframe.plans.registry import QUERIES


def test_lookups():
    assert L.BLOSUM62["W", "W"] == 11 and L.BLOSUM62["S", "T"] == L.BLOSUM62["T", "S"] == 1 and L.BLOSUM62["B", "D"] == 4 and L.BLOSUM62["*", "*"] == 1 and L.BLOSUM62["A", "*"] == -4
    assert len(L.BLOSUM62) == 576 and len(L.GRANTHAM) == 400
    assert L.GRANTHAM["S", "T"] == L.GRANTHAM["T", "S"] == 58 and L.GRANTHAM["W", "C"] == 215 and L.GRANTHAM["I", "L"] == 5 and ("X", "S") not in L.GRANTHAM


def _plain_score(a, b):
    """Best score over all alignments, by recursion over states."""
    best = {}

    def go(i, j, state):
        if (i, j, state) not in best:
            options = [0.0] if i == len(a) and j == len(b) else []
            if i < len(a) and j < len(b):
                options.append(L.BLOSUM62[a[i], b[j]] + go(i + 1, j + 1, 0))
            if i < len(a):
                options.append((-0.5 if state == 1 else -10.0) + go(i + 1, j, 1))
            if j < len(b):
                options.append((-0.5 if state == 2 else -10.0) + go(i, j + 1, 2))
            best[i, j, state] = max(options)
        return best[i, j, state]

    return go(0, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.text("ACDEFGHIKLMNPQRSTVWY", min_size=1, max_size=9), st.text("ACDEFGHIKLMNPQRSTVWY", min_size=1, max_size=9))
def test_alignment_score_is_the_best(a, b):
    x, y, score = alignment.gotoh(a, b)
    assert len(x) == len(y) and x.replace("-", "") == a and y.replace("-", "") == b and "--" not in {p + q for p, q in zip(x, y, strict=True)}
    assert math.isclose(score, _plain_score(a, b))
    state, total = 0, 0.0
    for p, q in zip(x, y, strict=True):
        now = 1 if q == "-" else 2 if p == "-" else 0
        total += L.BLOSUM62[p, q] if not now else (-0.5 if now == state else -10.0)
        state = now
    assert math.isclose(total, score)


def _rotation(rng):
    q = rng.normal(size=4)
    w, x, y, z = q / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def _rows(spark, clouds):
    rows = [(p, i, *map(float, a), *map(float, b)) for p, (ref, tgt) in clouds.items() for i, (a, b) in enumerate(zip(ref, tgt, strict=True))]
    return spark.createDataFrame(rows, "pair_id string, alignment_index int, reference_x double, reference_y double, reference_z double, target_x double, target_y double, target_z double")


def test_fit_undoes_motion_but_not_mirrors(spark):
    rng = np.random.default_rng(0)
    ref = rng.normal(size=(30, 3)) * 8 + 500
    noisy = ref + rng.normal(size=ref.shape)
    clouds = {"same": (ref, ref), "moved": (ref, ref @ _rotation(rng) + [1, 2, 3]), "noisy": (ref, noisy @ _rotation(rng) - 7), "mirror": (ref, ref * [1, 1, -1])}
    rows = _rows(spark, clouds)
    got = {r.pair_id: r.strict_rmsd for r in superposition.strict_rmsd(superposition.moved(rows, superposition.fit(rows))).collect()}
    assert got["same"] < 1e-9 and got["moved"] < 1e-9 and got["mirror"] > 1
    r, t = superposition.kabsch(ref, noisy)
    assert math.isclose(got["noisy"], np.sqrt(((noisy @ r + t - ref) ** 2).sum(1).mean()), rel_tol=1e-9)


def test_refinement_drops_the_outlier(spark):
    ref = np.array([[0, 0, 0], [4, 0, 0], [0, 4, 0], [0, 0, 4], [4, 4, 1], [1, 4, 4]], float)
    tgt = ref.copy()
    tgt[-1, 1] += 10
    rows = _rows(spark, {"p": (ref, tgt), "two": (ref[:2], ref[:2] + 1)})
    got = {r.pair_id: r for r in superposition.refined(rows, 1.5).collect()}
    assert got["p"].excluded == [5] and got["p"].refined_rmsd < 1e-9 and got["p"].refined_count == 5
    assert got["two"].refined_count == 2 and got["two"].refined_rmsd < 1e-9
    none = superposition.refined(_rows(spark, {"p": (ref, tgt)}), 1e-9, 1).first()
    assert none.refined_count == 0 and none.refined_rmsd is None


def test_hull_against_known_volumes():
    cube = np.array(list(itertools.product((0, 1), repeat=3)), float)
    assert math.isclose(sites.hull_volume(cube), 1.0) and math.isclose(sites.hull_volume(np.vstack([cube, cube.mean(0), cube[:1]])), 1.0)
    assert math.isclose(sites.hull_volume([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]]), 1 / 6)
    for flat in ([[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0]], [[0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]]):
        assert sites.hull_volume(flat) is None
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 3))
    samples = rng.uniform(points.min(0), points.max(0), size=(4000, 3))
    # A point is inside if no plane through three of the hull's points parts it from all the rest.
    outside = np.zeros(len(samples), bool)
    for a, b, c in itertools.combinations(range(60), 3):
        n = np.cross(points[b] - points[a], points[c] - points[a])
        side = (points - points[a]) @ n
        if (side <= 1e-12).all():
            outside |= (samples - points[a]) @ n > 0
        elif (side >= -1e-12).all():
            outside |= (samples - points[a]) @ n < 0
    estimate = (~outside).mean() * np.prod(np.ptp(points, axis=0))
    assert abs(sites.hull_volume(points) / estimate - 1) < 0.1


def test_grid_finds_all_pairs_within(spark):
    rng = np.random.default_rng(1)
    points = [(f"s{i % 2}", i, *map(float, p)) for i, p in enumerate(rng.uniform(-9, 9, size=(300, 3)))] + [("s0", 900, None, 0.0, 0.0), (None, 901, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(points, "g string, n int, x double, y double, z double")
    got = {(r.left_n, r.right_n) for r in spatial.within(df, df, 2.5, ["g"]).collect()}
    known = [p for p in points if None not in p]
    assert got == {(a[1], b[1]) for a in known for b in known if a[0] == b[0] and math.dist(a[2:], b[2:]) <= 2.5}


def _alignment(spark, *rows):
    return spark.createDataFrame([(f"p{i}", "r", f"t{i}", a, b) for i, (a, b) in enumerate(rows)], "pair_id string, reference_id string, target_id string, aligned_reference string, aligned_target string")


def test_correspondence_statuses_and_metrics(spark):
    rows = correspondence.explode_alignments(_alignment(spark, ("AC.DX", "A-WEA"), ("---", "ACD"), ("a", "a")))
    got = [(r.reference_ord, r.target_ord, r.status) for r in rows.filter("pair_id = 'p0'").orderBy("alignment_index").collect()]
    assert got == [(0, 0, "conserved"), (1, None, "deletion"), (None, 1, "insertion"), (2, 2, "substitution"), (3, 3, "nonstandard")]
    m = {r.pair_id: r for r in correspondence.sequence_metrics(rows).collect()}
    assert (m["p0"].identity, m["p0"].similarity, m["p0"].aligned_count, round(m["p0"].coverage, 6), round(m["p0"].target_coverage, 6)) == (0.5, 1.0, 2, 0.666667, 0.5)
    assert (m["p1"].identity, m["p1"].coverage, m["p1"].target_coverage, m["p1"].aligned_count) == (0.0, 0.0, 0.0, 0) and m["p2"].identity == 1.0
    with pytest.raises(Exception, match="differ in length"):
        correspondence.explode_alignments(_alignment(spark, ("AC", "A"))).collect()


def test_mutation_notation(spark):
    fields = ["pair_id", "alignment_index", "status"] + [f"{s}_{f}" for s in ("reference", "target") for f in ("aa", "key", "name", "num", "label")]
    side = lambda aa, name, num: (aa, f"k{num}", name, num, f"A:{num}") if name else (None,) * 5
    rows = [
        ("p", 0, "substitution", *side("A", "ALA", "12"), *side("G", "GLY", "14")), ("p", 1, "insertion", *side(None, None, None), *side("G", "GLY", "12A")), ("p", 2, "deletion", *side("K", "LYS", "5"), *side(None, None, None)),
        ("p", 3, "nonstandard", *side("X", "MSE", "5"), *side("A", "ALA", "5")), ("p", 4, "conserved", *side("W", "WAT", "7"), *side("W", "TRP", "7")), ("p", 5, "unmapped", *side("A", "ALA", "1"), *side(None, None, None)),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{f} {'int' if f == 'alignment_index' else 'string'}" for f in fields))
    got = [(r.kind, r.notation, r.blosum62, r.grantham, r["class"]) for r in mutations.detect(df).orderBy("alignment_index").collect()]
    assert got == [
        ("substitution", "A12G", 0, 60, "conservative"), ("insertion", "insertion:G:12A", None, None, None), ("deletion", "ΔLys5", None, None, None),
        ("nonstandard", "nonstandard:MSE:5->ALA:5", None, None, None), ("nonstandard", "nonstandard:WAT:7->TRP:7", None, None, None),
    ]


def test_manual_pairs_and_validation(spark):
    residues = spark.createDataFrame([(s, "A", str(i), None, f"{s}{i}", c) for s in "rt" for i, c in enumerate("ACD")], "structure_id string, chain_id string, auth_seq_id string, insertion_code string, residue_key string, one_letter string")
    pairs = spark.createDataFrame([("p", "r", "t", 0, "A:0", "A:0"), ("p", "r", "t", 1, "A:1", "A:2")], "pair_id string, reference_id string, target_id string, pair_ord int, reference_token string, target_token string")
    assert [(r.status, r.mapping_locked) for r in correspondence.manual_mapping(pairs, residues).orderBy("alignment_index").collect()] == [("conserved", True), ("substitution", True)]
    with pytest.raises(Exception, match="no such residue"):
        correspondence.manual_mapping(pairs.withColumn("target_token", F.lit("A:9")), residues).collect()
    rows = spark.createDataFrame([("p", "a", "x", 3.0), ("p", "a", "y", None), ("p", "b", "z", 1.0)], "pair_id string, reference_key string, target_key string, ca_displacement double")
    got = sorted((r.target_key, r.is_duplicate, r.is_outlier) for r in correspondence.validate(rows).collect())
    assert got == [("x", True, True), ("y", True, False), ("z", False, False)]


def test_alignment_rows():
    assert msa.against_first(["KDSGAF", "KDVGA"]) == ["KDSGAF", "KDVGA-"]
    assert msa.against_first(["ACDEF", "ACWDEF"]) == ["ACDEF-", "ACWDEF"]
    star = msa.center_star(["ACDEFGHIK", "ACWDEFGHIK", "WACDEFGHIK", "ACEFGHIK"])
    assert len({len(r) for r in star}) == 1 and [r.replace("-", "") for r in star] == ["ACDEFGHIK", "ACWDEFGHIK", "WACDEFGHIK", "ACEFGHIK"]
    assert star[0].index("C") == star[1].index("C") == star[2].index("C") and star[0][star[0].index("E")] == star[3][star[0].index("E")]


def test_insertions_of_targets_stay_apart(spark):
    rows = correspondence.explode_alignments(_alignment(spark, ("AC-D", "ACWD"), ("AC-D", "ACYD"), ("-ACD", "WACD")))
    moved = rows.withColumn("ca_displacement", F.when(F.col("reference_ord").isNotNull(), 1.0)).withColumn("target_key", F.concat("target_id", F.lit(":"), "target_ord"))
    reference = spark.createDataFrame([("r", i, f"r{i}") for i in range(4)], "reference_id string, reference_ord int, residue_key string")
    got = [(r.reference_key, r.mapped_count, r.coverage, r.variability and round(r.variability, 6)) for r in multi.positions(moved, reference).orderBy("position_index").collect()]
    spread = round(math.sqrt(3) / 4, 6)
    assert got == [(None, 1, 0.25, None), ("r0", 3, 1.0, spread), ("r1", 3, 1.0, spread), (None, 1, 0.25, None), (None, 1, 0.25, None), ("r2", 3, 1.0, spread), ("r3", 0, 0.25, None)]


def test_whole_analysis_of_a_moved_copy(spark):
    rng = np.random.default_rng(5)
    ref = rng.normal(size=(12, 3)) * 6
    places = {"r": ref, "t": ref @ _rotation(rng) + 4}
    sequence = "ACDEFGHIKLMN"
    residues = [(s, i, f"{s}{i}", "A", str(i + 1), None, L.THREE_LETTERS[c], *map(float, places[s][i])) for s in "rt" for i, c in enumerate(sequence)]
    df = spark.createDataFrame(residues, "structure_id string, residue_ord int, residue_key string, chain_id string, auth_seq_id string, insertion_code string, residue_name string, x double, y double, z double")
    chains = spark.createDataFrame([("r", sequence), ("t", sequence)], "structure_id string, sequence string")
    pairs = spark.createDataFrame([("r|t", "r", "t")], "pair_id string, reference_id string, target_id string")
    s = Analysis.of_sequences(pairs, chains, df).summary(refined=True).first()
    assert (s.identity, s.similarity, s.coverage, s.mutation_count, s.mapped_count, s.refined_count, s.mapping_mode, s.tm_score) == (1.0, 1.0, 1.0, 0, 12, 12, "sequence", None)
    assert s.strict_rmsd < 1e-9 and s.refined_rmsd < 1e-9
    empty = Analysis.of_sequences(pairs, chains, df.withColumns({c: F.lit(None).cast("double") for c in "xyz"})).summary(refined=True).first()
    assert empty.strict_rmsd is None and empty.refined_rmsd is None and empty.mapped_count == 0 and empty.identity == 1.0


def test_strict_validation_and_missing_chain(spark):
    import pytest
    from pyspark.errors import PySparkException

    from foldframe.operators import correspondence, interactions
    from foldframe.sources import structures

    rows = spark.createDataFrame([("p", "r1", "t1", 0.5), ("p", "r1", "t2", 3.0)], "pair_id string, reference_key string, target_key string, ca_displacement double")
    assert correspondence.validate(rows).count() == 2
    with pytest.raises(PySparkException, match="stands twice"):
        correspondence.validate(rows, strict=True).collect()
    assert correspondence.validate(rows.filter("target_key = 't1'"), strict=True).count() == 1
    chains = spark.createDataFrame([("s", "0", "A", 0, 3), ("u", "0", "B", 0, 2)], "structure_id string, model_id string, chain_id string, chain_ord int, residue_count int")
    with pytest.raises(PySparkException, match="no chain A in u"):
        structures.select_chain(chains, "A").collect()
    assert structures.select_chain(chains.filter("structure_id = 's'"), "A").count() == 1
    made = spark.createDataFrame([("p", "b", "x", "y", None), ("p", "a", None, None, "z"), ("p", "a", "q", None, None), ("p", "a", "q", "r", None)], "pair_id string, type string, pos_a string, pos_b string, external_id string")
    assert [(r.type, r.pos_a, r.pos_b) for r in interactions.ordered(made).collect()] == [("a", "q", "r"), ("a", "q", None), ("a", None, None), ("b", "x", "y")]


def test_contacts_are_formed_after_one_shuffle_by_structure(spark):
    from foldframe.operators import interactions
    from foldframe.plans import derived
    from tests.conftest import SF

    atoms = derived.atoms(spark, SF).filter("structure_id in ('v0', 'v1', 'v7')")
    found = interactions.heavy_contacts(atoms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(structure_id") == 1 and "SortMergeJoin" not in plan
    plain = {}
    rows = interactions._described(atoms).collect()
    greasy = {(r.structure_id, r.residue_key) for r in rows if r.side}
    for a in rows:
        for b in rows:
            if a.structure_id != b.structure_id or a.residue_ord >= b.residue_ord:
                continue
            d = ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) ** 0.5
            both = {(a.structure_id, r.residue_key) for r in (a, b)} <= greasy
            bond = d <= 3.5 and (a.donor and b.acceptor or b.donor and a.acceptor)
            kind = "hbond_geometric" if bond else "hydrophobic" if d <= 4.5 and both else None
            if kind or d <= 4.0 and (a.cationic and b.acidic or a.acidic and b.cationic):
                rank = (0, 0, a.atom_ord, b.atom_ord) if kind else (1, d, a.atom_ord, b.atom_ord)
                key, new = (a.structure_id, a.residue_key, b.residue_key), (rank, kind or "salt_bridge", a.name, b.name)
                plain[key] = min(plain.get(key, new), new)
    assert {(r.structure_id, r.residue_a, r.residue_b): (r.type, r.atom_a, r.atom_b) for r in found.collect()} == {k: v[1:] for k, v in plain.items()}


#: group, structure, ord, row: odd letters, equal ords (e, f), a structure without a row (h), a group of one (z).
ALIGNED = [
    (1, "b", 5, "ACD-FGXX"), (1, "a", 9, "ACDEFGHI"), (1, "c", 1, "acdw.ghi"), (1, "d", 2, "--------"), (1, "e", 3, "BZJX*WWY"), (1, "f", 3, "VLIMSTKR"), (1, "g", 4, "IVLMTSRK"), (1, "h", 6, None),
    (2, "z", 1, "AC"), (3, "b2", 2, "WY"), (3, "a2", 1, "FF"),
]


def _aligned(spark):
    return spark.createDataFrame([r[:3] for r in ALIGNED], "group_id int, structure_id string, ord int"), spark.createDataFrame([(s, r) for _, s, _, r in ALIGNED if r], "structure_id string, row string")


def _plain_matrices():
    out = {}
    for (g, r, i, a), (h, t, j, b) in itertools.permutations(ALIGNED, 2):
        if g == h and i < j and a and b:
            a, b = (x.upper().replace(".", "-") for x in (a, b))
            both = [(x, y) for x, y in zip(a, b, strict=True) if x in L.CANONICAL and y in L.CANONICAL]
            part = {"identity": sum(x == y for x, y in both), "similarity": sum(L.BLOSUM62[x, y] > 0 for x, y in both), "coverage": len(both)}
            whole = {"identity": len(both), "similarity": len(both), "coverage": sum(x in L.CANONICAL for x in a)}
            out |= {(g, m, *sorted((r, t))): part[m] / whole[m] if whole[m] else 0.0 for m in part}
    return out


@pytest.mark.parametrize("wide", [2, 1024])
def test_matrices_by_blocks(spark, monkeypatch, wide):
    monkeypatch.setattr(multi, "WIDE", wide)
    want = _plain_matrices()
    got = multi.row_matrices(*_aligned(spark)).collect()
    assert {(r.group_id, r.metric, r.left_id, r.right_id): r.value for r in got} == want and len(got) == len(want) == 63
    assert {r.unit for r in got} == {"fraction"}
    third = multi.row_matrices(*_aligned(spark), ["identity", "coverage"], 1).collect()
    assert {(r.metric, r.left_id, r.right_id): r.value for r in third} == {(m, a, b): math.floor(v * 10 + 0.5) / 10 for (_, m, a, b), v in want.items() if m != "similarity"}


def _shuffled(spark, df):
    """Rows of the result, and rows that its stages write to shuffles."""
    context = spark.sparkContext
    written = lambda: sum(s.shuffleWriteRecords() for s in context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)))
    before = written()
    rows = len(df.collect())
    context._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, written() - before


def test_no_pair_of_all_vs_all_is_shuffled(spark):
    from tests.conftest import SF

    rows, shuffled = _shuffled(spark, QUERIES["all_vs_all"](spark, SF))
    assert rows == 37032 and shuffled < rows / 6


@pytest.mark.parametrize("wide", [2, 1024])
def test_heatmap_by_blocks(spark, monkeypatch, wide):
    monkeypatch.setattr(multi, "WIDE", wide)
    values = {k[:1] + k[2:]: v for k, v in _plain_matrices().items() if k[1] == "identity"}
    got = multi.row_heatmap(*_aligned(spark), ["identity"], 4).collect()
    want = set()
    for (g, a, *_), (h, b, *_) in itertools.product(ALIGNED, repeat=2):
        v = values.get((g, *sorted((a, b))))
        if g == h:
            want.add((g, "identity", a, b, None if v is None else math.floor(v * 1e4 + 0.5) / 1e4, "—" if v is None else f"{v:.3f}", "diagonal" if a == b else "value"))
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 64 + 1 + 4


def test_no_cell_of_a_heatmap_is_shuffled(spark):
    from tests.conftest import SF

    rows, shuffled = _shuffled(spark, QUERIES["pairwise_heatmap"](spark, SF))
    assert rows == 25188 and shuffled < rows / 4
