"""Solvent-accessible surface by points on spheres around atoms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBE, POINTS = 1.4, 240
# Van der Waals radii in Angstrom; other elements take that of carbon.
RADII = {"H": 1.10, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "SE": 1.90, "ZN": 1.39}


def _sphere(n: int) -> np.ndarray:
    """Points spread evenly by a golden spiral."""
    k = np.arange(n) + 0.5
    z, turn = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(turn), r * np.sin(turn), z], 1)


def accessible(places: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Area of each atom that the probe's centre can reach."""
    sphere, big = _sphere(POINTS), radii + PROBE
    out = np.empty(len(places))
    order = np.argsort(places[:, 0], kind="stable")
    xs, reach = places[order, 0], 2 * big.max(initial=0.0)
    for i, (p, r) in enumerate(zip(places, big, strict=True)):
        near = order[np.searchsorted(xs, p[0] - reach) : np.searchsorted(xs, p[0] + reach, "right")]
        near = near[(near != i) & (np.linalg.norm(places[near] - p, axis=1) < r + big[near])]
        free = np.ones(POINTS, bool)
        for j in near:
            free &= np.linalg.norm(p + r * sphere - places[j], axis=1) >= big[j]
        out[i] = 4 * np.pi * r * r * free.mean()
    return out


def sasa(atoms: DataFrame) -> DataFrame:
    """structure_id, residue_key, sasa of each residue amid its whole structure; atoms without a place are left out. A group is one structure."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        radii = group.element.str.upper().map(RADII).fillna(RADII["C"]).to_numpy(float)
        area = accessible(group[["x", "y", "z"]].to_numpy(float), radii)
        return group.assign(sasa=area).groupby(["structure_id", "residue_key"], as_index=False).sasa.sum()

    own = atoms.select("structure_id", "residue_key", "element", "x", "y", "z").dropna(subset=["x", "y", "z"])
    return own.groupBy("structure_id").applyInPandas(run, "structure_id string, residue_key string, sasa double")


def site_sasa(members: DataFrame, atoms: DataFrame) -> DataFrame:
    """site_id, sasa: the sum over a site's residues (members: site_id, residue_key)."""
    return members.join(sasa(atoms), "residue_key").groupBy("site_id").agg(F.sum("sasa").alias("sasa"))
