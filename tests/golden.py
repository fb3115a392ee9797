"""Two small made-up chains as files, and what is pinned about them."""

from __future__ import annotations

# The pinned example, whose results must match.
#: Backbone start and side-chain atom of each residue; N, CA, C, O follow at fixed steps.
REFERENCE = [("LYS", -1.2, 0.0, 0.0, ("NZ", 1.4, 0.4, 1.1)), ("ASP", 2.6, 0.0, 0.0, ("OD1", 2.9, 0.9, -1.2)), ("SER", 6.4, 1.1, 0.6, ("OG", 7.6, 1.4, 2.0)), ("GLY", 10.2, 0.0, 1.3, None), ("ALA", 14.0, 0.5, 0.0, ("CB", 15.2, 1.5, 1.4)), ("PHE", 17.8, 0.0, 0.0, ("CZ", 19.0, 3.0, 0.9))]
TARGET = [("LYS", -1.2, 0.0, 0.5, ("NZ", 1.4, 0.4, 1.6)), ("ASP", 2.6, 0.0, 0.5, ("OD1", 2.9, 0.9, -0.7)), ("VAL", 6.4, 1.1, 1.1, ("CB", 7.6, 1.4, 2.5)), ("GLY", 10.2, 0.0, 1.8, None), ("ALA", 14.0, 1.7, 0.5, ("CB", 15.2, 2.7, 1.9))]
LIGAND = {"reference": (5.7, 0.4, 0.3), "target": (5.7, 0.4, 0.8)}


def pdb(chain, ligand) -> str:
    lines, serial = [], 0

    def add(kind, name, residue, number, x, y, z, element):
        nonlocal serial
        serial += 1
        lines.append(f"{kind:<6}{serial:>5}  {name:<3} {residue} A{number:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00 20.00          {element:>2}  ")

    for number, (residue, x, y, z, side) in enumerate(chain, 1):
        for name, dx, dy, dz in (("N", 0, 0, 0), ("CA", 1.2, 0, 0), ("C", 2.4, 0, 0), ("O", 2.4, 1.1, 0.4)):
            add("ATOM", name, residue, number, x + dx, y + dy, z + dz, name[0])
        if side:
            add("ATOM", side[0], residue, number, *side[1:], side[0][0])
    add("HETATM", "C1", "LIG", 900, *ligand, "C")
    return "\n".join([*lines, "END", ""])


def write(folder) -> list[str]:
    for name, chain in (("reference", REFERENCE), ("target", TARGET)):
        (folder / f"{name}.pdb").write_text(pdb(chain, LIGAND[name]))
    return [str(folder / "reference.pdb"), str(folder / "target.pdb")]
