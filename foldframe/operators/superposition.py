"""Rigid-body fits of mapped C-alpha atoms, RMSDs and refinement.

Transforms act on row vectors: target * rotation + translation lies on the
reference. Moments are built-in aggregates; only the 3 x 3 decomposition of one
row per pair, and the refinement loop within a pair, run in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldframe.functions.lookups import BACKBONE, SWAPS

REFINED_CUTOFF, REFINED_ITERATIONS = 2.0, 10


def kabsch(reference: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of the least squares fit, without reflection."""
    a, b = reference.mean(0), target.mean(0)
    r = _rotation((target - b).T @ (reference - a))
    return r, a - b @ r


def _rotation(covariance: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(covariance)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        u[..., -1] *= -1
    return u @ vt


def _fits(rows: pd.DataFrame) -> pd.DataFrame:
    cov = rows[[f"c{a}{b}" for a in "xyz" for b in "xyz"]].to_numpy(float).reshape(-1, 3, 3)
    out_r, out_t = [], []
    for c, ref, tgt in zip(cov, rows[["rx", "ry", "rz"]].to_numpy(float), rows[["tx", "ty", "tz"]].to_numpy(float), strict=True):
        r = _rotation(c)
        out_r.append(r.ravel().tolist())
        out_t.append((ref - tgt @ r).tolist())
    return pd.DataFrame({"rotation": out_r, "translation": out_t})


def fit(rows: DataFrame) -> DataFrame:
    """Mapped rows (pair_id, reference_x.., target_x..) -> pair_id, rotation (9, by rows), translation (3), atom_count."""
    own = rows.filter(" and ".join(f"{s}_{c} is not null" for s in ("reference", "target") for c in "xyz"))
    moments = own.groupBy("pair_id").agg(
        *[F.covar_pop(f"target_{a}", f"reference_{b}").alias(f"c{a}{b}") for a in "xyz" for b in "xyz"],
        *[F.avg(f"{side}_{c}").alias(f"{side[0]}{c}") for side in ("reference", "target") for c in "xyz"],
        F.count(F.lit(1)).alias("atom_count"),
    )

    @F.pandas_udf("rotation array<double>, translation array<double>")
    def solve(*cols: pd.Series) -> pd.DataFrame:
        return _fits(pd.concat(cols, axis=1, keys=names))

    names = [c for c in moments.columns if c not in ("pair_id", "atom_count")]
    return moments.select("pair_id", "atom_count", solve(*names).alias("f")).select("pair_id", "f.rotation", "f.translation", "atom_count")


def moved(rows: DataFrame, transforms: DataFrame) -> DataFrame:
    """Adds moved_x, moved_y, moved_z (target places in the reference's frame) and ca_displacement; null where either side is."""
    own = rows.join(transforms.select("pair_id", "rotation", "translation"), "pair_id", "left")
    out = {}
    for j, c in enumerate("xyz"):
        parts = [F.col(f"target_{a}") * F.get("rotation", F.lit(3 * i + j)) for i, a in enumerate("xyz")]
        out[f"moved_{c}"] = parts[0] + parts[1] + parts[2] + F.get("translation", F.lit(j))
    return own.withColumns(out).drop("rotation", "translation").withColumn("ca_displacement", distance("reference", "moved"))


def distance(a: str, b: str) -> Column:
    """Distance of the places in columns a_x.. and b_x.."""
    return F.sqrt(sum(((F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) * (F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) for c in "xyz"), F.lit(0.0)))


def rmsd(of: Column) -> Column:
    """Root of the mean of squares: an aggregate."""
    return F.sqrt(F.avg(of * of))


def strict_rmsd(moved_rows: DataFrame) -> DataFrame:
    """pair_id, strict_rmsd, mapped_count."""
    own = moved_rows.filter("ca_displacement is not null")
    return own.groupBy("pair_id").agg(rmsd(F.col("ca_displacement")).alias("strict_rmsd"), F.count(F.lit(1)).alias("mapped_count"))


def _refine(reference: np.ndarray, target: np.ndarray, cutoff: float, iterations: int, library: bool) -> tuple[np.ndarray, float | None]:
    keep = np.ones(len(reference), bool)
    if len(reference) < 3 and not library:
        return keep, _after(reference, target, keep)
    value = None
    for _ in range(iterations):
        if library:
            value = _after(reference, target, keep)
        r, t = kabsch(reference[keep], target[keep])
        now = np.linalg.norm(target @ r + t - reference, axis=1) <= cutoff
        if library and not now.any():
            break
        same = bool((now == keep).all())
        keep = now
        if same or not keep.any():
            break
    return keep, value if library else _after(reference, target, keep)


def _after(reference: np.ndarray, target: np.ndarray, keep: np.ndarray) -> float | None:
    if not keep.any():
        return None
    r, t = kabsch(reference[keep], target[keep])
    return float(np.sqrt((((target @ r + t - reference)[keep]) ** 2).sum(1).mean()))


def refined(rows: DataFrame, cutoff: float = REFINED_CUTOFF, iterations: int = REFINED_ITERATIONS, mode: str = "service") -> DataFrame:
    """pair_id, refined_rmsd, refined_count, excluded (alignment indices left out).

    Each pass fits what is kept and tests all pairs against the cutoff, until
    nothing changes. service: the final set is fitted again; an empty set gives
    null and 0; fewer than three pairs are taken as they are. library: the value
    is that of the last fit. A group is one chain.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("alignment_index")
        a = group[["reference_x", "reference_y", "reference_z"]].to_numpy(float)
        b = group[["target_x", "target_y", "target_z"]].to_numpy(float)
        keep, value = _refine(a, b, cutoff, iterations, mode == "library")
        return pd.DataFrame({"pair_id": [group.pair_id.iloc[0]], "refined_rmsd": [value], "refined_count": [int(keep.sum())], "excluded": [group.alignment_index[~keep].tolist()]})

    places = [f"{s}_{c}" for s in ("reference", "target") for c in "xyz"]
    own = rows.select("pair_id", "alignment_index", *places).dropna(subset=places)
    return own.groupBy("pair_id").applyInPandas(run, "pair_id string, refined_rmsd double, refined_count int, excluded array<int>")


def residue_rmsd(rows: DataFrame, atoms: DataFrame, transforms: DataFrame) -> DataFrame:
    """backbone_rmsd, sidechain_rmsd, all_heavy_rmsd of each mapped residue pair, targets moved by their pair's transform.

    Backbone needs N, CA, C, O on both sides; the others need the same heavy
    atoms on both sides. Atoms that trade names in an equivalent pose are tried
    both ways, together, and the smaller value counts. Otherwise null.
    """
    heavy = atoms.filter(~F.regexp_replace("name", "^[0-9]+", "").startswith("H")).select("residue_key", "name", "residue_name", "x", "y", "z")
    mapped = rows.filter("reference_key is not null and target_key is not null").select("pair_id", "alignment_index", "reference_key", "target_key")
    side = lambda s, key: mapped.select("pair_id", "alignment_index", F.col(key).alias("residue_key")).join(heavy, "residue_key").select(
        "pair_id", "alignment_index", "name", *([F.col("residue_name")] if s == "r" else []), *[F.col(c).alias(f"{s}{c}") for c in "xyz"]
    )
    pairs = side("r", "reference_key").join(side("t", "target_key"), ["pair_id", "alignment_index", "name"], "full_outer")
    # The same atoms with traded names, from the same rows.
    swaps = [(res, a, b) for res, table in SWAPS.items() for x, y in table.items() for a, b in ((x, y), (y, x))]
    table = F.broadcast(rows.sparkSession.createDataFrame(swaps, "residue_name string, name string, other string"))
    grouped = pairs.join(table, ["residue_name", "name"], "left").join(transforms.select("pair_id", "rotation", "translation"), "pair_id")
    each = grouped.groupBy("pair_id", "alignment_index").agg(
        F.collect_list(F.struct("name", "rx", "ry", "rz", "tx", "ty", "tz", "other")).alias("a"), F.first("rotation").alias("rot"), F.first("translation").alias("tr"), F.max("residue_name").alias("residue_name")
    )
    places = F.map_from_entries(F.transform(F.filter("a", lambda s: s["tx"].isNotNull()), lambda s: F.struct(s["name"], F.struct(s["tx"].alias("x"), s["ty"].alias("y"), s["tz"].alias("z")))))
    each = each.withColumn("at", places)
    each = each.withColumn("sq", F.transform("a", lambda s: F.struct(
        s["name"].alias("name"), s["rx"].isNotNull().alias("in_r"), s["tx"].isNotNull().alias("in_t"), s["other"].alias("other"),
        _square(s, F.col("at")[s["name"]]).alias("same"), _square(s, F.col("at")[F.coalesce(s["other"], s["name"])]).alias("traded"),
    )))
    back = F.filter("sq", lambda s: s["name"].isin(*BACKBONE) & s["in_r"] & s["in_t"])
    side_chain = F.filter("sq", lambda s: ~s["name"].isin(*BACKBONE))
    alike = lambda sq: F.forall(sq, lambda s: s["in_r"] & s["in_t"])
    needed = {res: sorted(n for kv in t.items() for n in kv) for res, t in SWAPS.items()}
    groups = F.create_map(*[x for res, names in needed.items() for x in (F.lit(res), F.array(*[F.lit(n) for n in names]))])
    trades = F.coalesce(F.size(F.array_except(F.try_element_at(groups, F.col("residue_name")), F.transform("sq", lambda s: s["name"]))) == 0, F.lit(False))
    value = lambda sq: F.when(F.size(sq) > 0, F.least(_root_mean(sq, "same"), F.when(trades, _root_mean(sq, "traded"))))
    return each.select(
        "pair_id", "alignment_index",
        F.when(F.size(back) == 4, _root_mean(back, "same")).alias("backbone_rmsd"),
        F.when(alike(side_chain), value(side_chain)).alias("sidechain_rmsd"),
        F.when(alike(F.col("sq")), value(F.col("sq"))).alias("all_heavy_rmsd"),
    )


def _square(s: Column, place: Column) -> Column:
    """Squared distance from a reference atom to a target place moved by the row's transform."""
    out = F.lit(0.0)
    for j, c in enumerate("xyz"):
        to = place["x"] * F.col("rot")[j] + place["y"] * F.col("rot")[3 + j] + place["z"] * F.col("rot")[6 + j] + F.col("tr")[j]
        out = out + (to - s[f"r{c}"]) * (to - s[f"r{c}"])
    return out


def _root_mean(sq: Column, field: str) -> Column:
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda n, s: n + s[field]) / F.size(sq))
