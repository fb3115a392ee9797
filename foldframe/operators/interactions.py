"""Non-covalent contacts within a structure, and their comparison across a pair.

Atoms: structure_id, residue_key, residue_ord, residue_name, atom_ord, name,
element, x, y, z. Contacts come from grids of cells; what the first hit of a scan
over atoms is follows from the ordinals that atoms carry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldframe.functions.lookups import ACCEPTORS, ACIDIC, CATION_GROUPS, CATIONIC, DONORS, HYDROPHOBIC, METALS, RINGS
from foldframe.operators.spatial import HALF, pairs_within, within

TYPES = ("hbond_geometric", "salt_bridge", "hydrophobic", "pi_stacking", "cation_pi", "metal_contact")
COLUMNS = ["structure_id", "type", "residue_a", "residue_b", "atom_a", "atom_b", "distance", "angle", "external_id", "evidence_mode"]


@dataclass(frozen=True)
class Thresholds:
    """In Angstrom and degrees."""

    hbond: float = 3.5
    salt_bridge: float = 4.0
    hydrophobic: float = 4.5
    pi_centroid: float = 5.5
    cation_pi: float = 6.0
    metal: float = 3.0
    parallel: float = 30.0
    t_shape_min: float = 60.0
    t_shape_max: float = 120.0
    cation_normal: float = 45.0


def is_donor(name: Column, element: Column) -> Column:
    return F.upper(F.trim(name)).isin(*DONORS) & F.upper(element).isin("N", "O", "S")


def is_acceptor(name: Column, element: Column) -> Column:
    return F.upper(F.trim(name)).isin(*ACCEPTORS) & F.upper(element).isin("N", "O", "S")


def _described(atoms: DataFrame) -> DataFrame:
    """Atoms that have a place, with what their residue is; side marks a side-chain carbon or sulphur, one of which makes a residue hydrophobic."""
    side = F.upper("residue_name").isin(*HYDROPHOBIC) & ~F.upper("name").isin("N", "CA", "C", "O", "OXT") & F.upper("element").isin("C", "S")
    marks = {
        "side": side & F.col("residue_key").isNotNull(), "donor": is_donor(F.col("name"), F.col("element")), "acceptor": is_acceptor(F.col("name"), F.col("element")),
        "cationic": F.upper("residue_name").isin(*CATIONIC), "acidic": F.upper("residue_name").isin(*ACIDIC),
    }
    placed = atoms.filter("structure_id is not null and residue_ord is not null and x is not null and y is not null and z is not null")
    columns = [F.col("structure_id"), F.col("residue_key"), F.col("residue_ord").cast("long"), F.col("atom_ord").cast("long"), F.col("name")]
    return placed.select(*columns, *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.coalesce(c, F.lit(False)).alias(name) for name, c in marks.items()])


#: Atoms of a batch at least, whole structures; pairs of a step at most.
ATOMS, PAIRS = 1 << 14, 1 << 20
_DONOR, _ACCEPTOR, _GREASY, _CATIONIC, _ACIDIC = 1, 2, 4, 8, 16


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by structure, cut between structures."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ATOMS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["structure_id"]
        last = pc.index(pc.equal(ids, ids[-1]), True).as_py()
        if last:
            yield table.slice(0, last)
        held, rows = table.slice(last).to_batches(), 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near(keys: np.ndarray, steps: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places (left, right) of points whose keys differ by a step, and whether it is the first, a cell with itself."""
    order = np.argsort(keys, kind="stable")
    cells = keys[order]
    for nth, step in enumerate(steps):
        wanted = keys + np.array(step, np.uint64)
        first = np.searchsorted(cells, wanted, "left")
        counts = np.searchsorted(cells, wanted, "right") - first
        ends = np.cumsum(counts)
        at = 0
        while at < len(keys):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            n = counts[at:to]
            left = np.repeat(np.arange(at, to), n)
            right = order[np.arange(len(left)) - np.repeat(ends[at:to] - n - done, n) + np.repeat(first[at:to], n)]
            yield left, right, not nth
            at = to


def _heavy(table: pa.Table, limits: Thresholds) -> pa.RecordBatch:
    """Contacts within whole structures, by cells; points of two cells with one key by chance are told apart by structure and distance."""
    number = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    x, y, z = (number(c) for c in "xyz")
    ids = pc.dictionary_encode(table["structure_id"]).combine_chunks().indices.to_numpy()
    names = pc.dictionary_encode(table["residue_key"]).combine_chunks().indices.fill_null(-1).to_numpy().astype(np.int64) + 1
    residue = np.unique(ids * (names.max() + 1) + names, return_inverse=True)[1]
    greasy = np.bincount(residue, number("side")) > 0
    has = number("donor") * _DONOR | number("acceptor") * _ACCEPTOR | greasy[residue] * _GREASY | number("cationic") * _CATIONIC | number("acidic") * _ACIDIC
    own = np.flatnonzero((has > 0) & np.isfinite(x) & np.isfinite(y) & np.isfinite(z))
    x, y, z, ids, residue, has = x[own], y[own], z[own], ids[own], residue[own], has[own].astype(np.uint8)
    ords, nths = number("residue_ord")[own], table["atom_ord"].combine_chunks().fill_null(-(1 << 62)).to_numpy()[own]
    meets = np.zeros(32, np.uint8)
    for bit, other in ((_DONOR, _ACCEPTOR), (_ACCEPTOR, _DONOR), (_GREASY, _GREASY), (_CATIONIC, _ACIDIC), (_ACIDIC, _CATIONIC)):
        meets[np.arange(32) & bit > 0] |= other
    meets = meets[has]
    reach = max(limits.hbond, limits.hydrophobic, limits.salt_bridge)
    odd = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
    cells = [ids, *(np.floor(c / reach).clip(-(2.0**62), 2.0**62).astype(np.int64) for c in (x, y, z))]
    keys = sum((c.astype(np.uint64) * np.uint64(m) for c, m in zip(cells, odd, strict=True)), np.zeros(len(own), np.uint64))
    steps = [sum(d * m for d, m in zip(offset, odd[1:], strict=True)) % (1 << 64) for offset in HALF]
    found = []
    for a, b, itself in _near(keys, steps):
        take = (has[a] & meets[b] > 0) & (ords[a] != ords[b]) & (ids[a] == ids[b])
        if itself:
            take &= a < b
        a, b = a[take], b[take]
        dx, dy, dz = x[a] - x[b], y[a] - y[b], z[a] - z[b]
        apart = np.sqrt(dx * dx + dy * dy + dz * dz)
        shared = has[a] & meets[b]
        bond = (apart <= limits.hbond) & (shared & (_DONOR | _ACCEPTOR) > 0)
        grease = (apart <= limits.hydrophobic) & (shared & _GREASY > 0)
        bridge = (apart <= limits.salt_bridge) & (shared & (_CATIONIC | _ACIDIC) > 0)
        kind = np.where(bond, 0, np.where(grease, 1, 2))
        hit = bond | grease | bridge
        a, b, apart, kind = a[hit], b[hit], apart[hit], kind[hit]
        turned = ords[a] > ords[b]
        found.append((np.where(turned, b, a), np.where(turned, a, b), apart, kind))
    a, b, apart, kind = (np.concatenate(parts) for parts in zip((np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, int)), *found, strict=True))
    pair = residue[a] * (residue.max(initial=0) + 1) + residue[b]
    # A bond or grease before any bridge; of these the first in scan order, of bridges the closest.
    order = np.lexsort((nths[b], nths[a], np.where(kind == 2, apart, 0.0), kind == 2, pair))
    best = order[np.concatenate(([True], pair[order][1:] != pair[order][:-1]))] if len(order) else order
    rows = [pa.array(own[side[best]]) for side in (a, b)]
    get = lambda c, side=0: table[c].combine_chunks().take(rows[side])
    kinds = pa.array(["hbond_geometric", "hydrophobic", "salt_bridge"]).take(pa.array(kind[best]))
    return pa.RecordBatch.from_arrays(
        [get("structure_id"), kinds, get("residue_key"), get("residue_key", 1), get("name"), get("name", 1), pa.array(apart[best])], names=["structure_id", "type", "residue_a", "residue_b", "atom_a", "atom_b", "distance"]
    )


def heavy_contacts(atoms: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """At most one of hbond_geometric, hydrophobic and salt_bridge for each pair of residues.

    The first pair of atoms, in scan order, that is a hydrogen bond or, both
    residues being hydrophobic, a hydrophobic contact; without any, the closest
    atoms of an acid and a base. Atoms are shuffled once, by structure; their
    pairs are formed and settled where the structure is and never written.
    """
    own = _described(atoms)
    kind = own.schema["structure_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batch for batch in batches if batch.num_rows):
            yield _heavy(table, limits)

    found = own.repartition("structure_id").sortWithinPartitions("structure_id").mapInArrow(run, f"structure_id {kind}, type string, residue_a string, residue_b string, atom_a string, atom_b string, distance double")
    return found.select("*", F.lit(None).cast("double").alias("angle"), F.lit(None).cast("string").alias("external_id"), F.lit("heavy_atom_geometry").alias("evidence_mode"))


def _group_table(atoms: DataFrame, rows: list[tuple], ring: bool) -> DataFrame:
    """Complete groups of atoms with their centroid, and with the normal for rings."""
    table = atoms.sparkSession.createDataFrame(rows, "residue_name string, grp int, nth int, name string, size int")
    own = atoms.select("structure_id", "residue_key", "residue_ord", F.upper(F.trim("residue_name")).alias("residue_name"), F.upper(F.trim("name")).alias("name"), "x", "y", "z")
    members = own.join(F.broadcast(table), ["residue_name", "name"])
    sums = members.groupBy("structure_id", "residue_key", "residue_ord", "residue_name", "grp", "size").agg(
        *[F.avg(c).alias(c) for c in "xyz"], F.min_by("name", "nth").alias("name"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("nth", *[F.col(c).alias(f"p{c}") for c in "xyz"]))).alias("p")
    )
    full = sums.filter("n = size").drop("n", "size", "residue_name")
    if not ring:
        return full.drop("p")
    # By arrays in one step, since an expression would be worked out anew for each of its readers.
    kinds = {c: full.schema[c].dataType.simpleString() for c in ("structure_id", "residue_ord")}
    schema = f"structure_id {kinds['structure_id']}, residue_key string, residue_ord {kinds['residue_ord']}, grp int, name string, x double, y double, z double, nx double, ny double, nz double"
    return full.select("structure_id", "residue_key", "residue_ord", "grp", "name", "x", "y", "z", "p").mapInArrow(_normals, schema)


def _normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rings with their atoms' places p -> with the normal: of the products of two centred atoms the longest, the first of equal ones."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        ring = columns.pop("p")
        centre = np.stack([columns[c].to_numpy(zero_copy_only=False) for c in "xyz"], 1)
        sizes = pc.list_value_length(ring).to_numpy(zero_copy_only=False)
        places = np.stack([ring.flatten().field(f"p{c}").to_numpy(zero_copy_only=False) for c in "xyz"], 1)
        starts = np.cumsum(sizes) - sizes
        normal, length = np.zeros((len(sizes), 3)), np.zeros(len(sizes))
        for size in np.unique(sizes[sizes > 1]).tolist():
            of = np.flatnonzero(sizes == size)
            centred = places[starts[of, None] + np.arange(size)] - centre[of, None]
            i, j = np.triu_indices(size, 1)
            (ax, ay, az), (bx, by, bz) = np.moveaxis(centred[:, i], 2, 0), np.moveaxis(centred[:, j], 2, 0)
            x, y, z = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
            n = np.sqrt(x * x + y * y + z * z)
            best = np.arange(len(of)), n.argmax(1)
            normal[of], length[of] = np.stack([x[best], y[best], z[best]], 1), n[best]
        kept = np.flatnonzero(length > 1e-12)
        unit = normal[kept] / length[kept, None]
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept)) for c in columns.values()), *(pa.array(unit[:, k]) for k in range(3))], names=[*columns, "nx", "ny", "nz"])


def rings(atoms: DataFrame) -> DataFrame:
    """Centroid and normal (nx, ny, nz) of each complete aromatic ring; name is that of its first atom."""
    return _group_table(atoms, [(res, grp, i, name, len(names)) for (res, grp), names in RINGS.items() for i, name in enumerate(names)], True)


def cation_groups(atoms: DataFrame) -> DataFrame:
    """Centroid of each complete cationic group."""
    return _group_table(atoms, [(res, 0, i, name, len(names)) for res, names in CATION_GROUPS.items() for i, name in enumerate(names)], False)


def _angle(ax: list[str], bx: list[Column]) -> Column:
    """Degrees between a vector of columns and one of expressions; null if either has no length."""
    dot = sum((F.col(a) * b for a, b in zip(ax, bx, strict=True)), F.lit(0.0))
    na = F.sqrt(sum((F.col(a) * F.col(a) for a in ax), F.lit(0.0)))
    nb = F.sqrt(sum((b * b for b in bx), F.lit(0.0)))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (na * nb)))
    return F.when((na > 1e-12) & (nb > 1e-12), F.degrees(F.acos(cosine)))


def pi_stacking(atoms: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """The best pair of rings of each pair of residues: parallel or T-shaped, by distance, then folded angle."""
    own = rings(atoms)
    near = pairs_within(own, limits.pi_centroid, ["structure_id"], "residue_ord")
    full = _angle(["left_nx", "left_ny", "left_nz"], [F.col(f"right_n{c}") for c in "xyz"])
    near = near.withColumn("full", full).withColumn("angle", F.least(F.col("full"), 180.0 - F.col("full")))
    fits = near.filter((F.col("angle") <= limits.parallel) | F.col("full").between(limits.t_shape_min, limits.t_shape_max))
    return _best(fits, F.col("left_residue_key"), F.col("right_residue_key"), F.col("left_name"), F.col("right_name"), "pi_stacking", "aromatic_ring_geometry")


def cation_pi(atoms: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """The best ring and cation of each pair of residues.

    If the first residue of a pair can be a cation, only its cation and the
    second's ring are tried, otherwise the second's cation and the first's ring.
    """
    near = within(rings(atoms), cation_groups(atoms), limits.cation_pi, ["structure_id"]).filter("left_residue_ord <> right_residue_ord")
    full = _angle(["left_nx", "left_ny", "left_nz"], [F.col(f"right_{c}") - F.col(f"left_{c}") for c in "xyz"])
    near = near.withColumn("full", full).withColumn("angle", F.least(F.col("full"), 180.0 - F.col("full"))).filter(F.col("angle") <= limits.cation_normal)
    cation_first = F.col("right_residue_ord") < F.col("left_residue_ord")
    ring_can_be_cation = atoms.filter(F.upper("residue_name").isin(*CATIONIC)).select("structure_id", F.col("residue_key").alias("left_residue_key")).distinct().withColumn("both", F.lit(True))
    near = near.join(ring_can_be_cation, ["structure_id", "left_residue_key"], "left").filter(cation_first | F.col("both").isNull())
    pick = lambda a, b: F.when(cation_first, F.col(a)).otherwise(F.col(b))
    return _best(near, pick("right_residue_key", "left_residue_key"), pick("left_residue_key", "right_residue_key"), pick("right_name", "left_name"), pick("left_name", "right_name"), "cation_pi", "cation_ring_geometry")


def _best(rows: DataFrame, a: Column, b: Column, atom_a: Column, atom_b: Column, kind: str, evidence: str) -> DataFrame:
    best = rows.groupBy("structure_id", a.alias("residue_a"), b.alias("residue_b")).agg(
        F.min_by(F.struct(atom_a.alias("atom_a"), atom_b.alias("atom_b"), "distance", "angle"), F.struct("distance", "angle", "left_grp", "right_grp")).alias("c")
    )
    return best.select("structure_id", F.lit(kind).alias("type"), "residue_a", "residue_b", "c.atom_a", "c.atom_b", "c.distance", "c.angle", F.lit(None).cast("string").alias("external_id"), F.lit(evidence).alias("evidence_mode"))


def metal_contacts(atoms: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """For each metal atom (by element) and each other residue the first atom in range."""
    slim = atoms.select("structure_id", "residue_key", "residue_ord", "atom_ord", "name", "x", "y", "z", F.upper("element").alias("element"))
    near = within(slim.filter(F.col("element").isin(*METALS)), slim, limits.metal, ["structure_id"]).filter("left_residue_key <> right_residue_key")
    first = near.groupBy("structure_id", F.col("left_residue_key").alias("residue_a"), F.col("right_residue_key").alias("residue_b"), "left_atom_ord", F.col("left_name").alias("atom_a")).agg(
        F.min_by(F.struct(F.col("right_name").alias("atom_b"), "distance"), "right_atom_ord").alias("c")
    )
    return first.select("structure_id", F.lit("metal_contact").alias("type"), "residue_a", "residue_b", "atom_a", "c.atom_b", "c.distance", F.lit(None).cast("double").alias("angle"), F.col("atom_a").alias("external_id"), F.lit("heavy_atom_geometry").alias("evidence_mode"))


def detect(atoms: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """All contacts of each structure."""
    out = heavy_contacts(atoms, limits)
    for part in (pi_stacking(atoms, limits), cation_pi(atoms, limits), metal_contacts(atoms, limits)):
        out = out.unionByName(part)
    return out.select(*COLUMNS)


def compare(contacts: DataFrame, mapping: DataFrame, keep_unmapped_reference: bool = False) -> DataFrame:
    """Contacts of reference and target of each pair on mapped positions: conserved, lost, gained, target_only_unmapped.

    mapping: pair_id, reference_id, target_id, position, reference_key,
    target_key (null where that side has none). Ends are ordered as text. Of
    contacts with the same key the last counts, by residues and atoms.
    Reference contacts with an unmapped end drop out unless they are asked for
    as reference_only_unmapped.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("structure_id")) for s in ("reference", "target")])
    pairs = mapping.select("pair_id", "reference_id", "target_id").distinct().select("pair_id", F.explode(sides).alias("s")).select("pair_id", "s.*")
    ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_key").alias("key")) for s in ("reference", "target")])
    places = mapping.select("pair_id", "position", F.explode(ends).alias("s")).select("pair_id", "position", "s.*").filter("key is not null")
    # A residue's places in a row for each pair and side, looked up where contacts meet it: contacts of a pair are shuffled once, not for each end.
    places = places.groupBy("pair_id", "side", "key").agg(F.collect_list("position").alias("at")).groupBy("pair_id", "side").agg(F.map_from_entries(F.collect_list(F.struct("key", "at"))).alias("places"))
    rows = contacts.join(pairs.join(places, ["pair_id", "side"], "left"), "structure_id")
    for end in ("a", "b"):
        rows = rows.withColumn(f"at_{end}", F.explode_outer(F.try_element_at("places", F.col(f"residue_{end}"))))
    rows = rows.drop("places", "angle", "evidence_mode").repartition("pair_id")
    mapped = F.col("at_a").isNotNull() & (F.col("residue_b").isNull() | F.col("at_b").isNotNull())
    rows = rows.withColumns({"mapped": mapped, "pos_a": F.when(mapped, F.least("at_a", "at_b")).otherwise("unmapped"), "pos_b": F.when(mapped & F.col("residue_b").isNotNull(), F.greatest("at_a", "at_b"))})
    last = F.struct("residue_a", "residue_b", "atom_a", "atom_b")
    sided = lambda side: F.max_by("distance", F.when(F.col("side") == side, last)).alias(f"{side}_distance")
    # Contacts that keep no position stay apart, by themselves.
    keep = F.col("mapped") | (F.col("side") == "target") | F.lit(keep_unmapped_reference)
    alone = F.when(~F.col("mapped"), F.struct("side", "structure_id", last))
    out = rows.filter(keep).groupBy("pair_id", "type", "pos_a", "pos_b", "external_id", alone.alias("alone")).agg(sided("reference"), sided("target"))
    change = (
        F.when(F.col("alone").isNotNull(), F.concat("alone.side", F.lit("_only_unmapped")))
        .when(F.col("reference_distance").isNull(), "gained")
        .when(F.col("target_distance").isNull(), "lost")
        .otherwise("conserved")
    )
    return out.select("pair_id", "type", "pos_a", "pos_b", "external_id", change.alias("change"), "reference_distance", "target_distance")


def ordered(differences: DataFrame) -> DataFrame:
    """By pair, type, ends and external id, those that are null last: the order of a report."""
    return differences.orderBy("pair_id", "type", F.asc_nulls_last("pos_a"), F.asc_nulls_last("pos_b"), F.asc_nulls_last("external_id"))


def fingerprint(differences: DataFrame, members: DataFrame) -> DataFrame:
    """Counts by site, pair and type of the differences that touch a site's positions (members: site_id, pair_id, position)."""
    ends = differences.withColumn("position", F.explode(F.array_distinct(F.filter(F.array("pos_a", "pos_b"), lambda p: p.isNotNull()))))
    touched = ends.join(members, ["pair_id", "position"]).select("site_id", "pair_id", "type", "pos_a", "pos_b", "external_id", "change").distinct()
    is_ = lambda *names: F.count_if(F.col("change").isin(*names))
    return touched.groupBy("site_id", "pair_id", "type").agg(
        is_("conserved", "lost").alias("reference_count"), is_("conserved", "gained").alias("target_count"), is_("conserved").alias("conserved_count"), is_("gained").alias("gained_count"), is_("lost").alias("lost_count")
    )
