"""Command line: python -m foldframe compare REFERENCE TARGET."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foldframe.plans import reports
from foldframe.plans.engine import Analysis
from foldframe.sources import sinks, structures


def compare(spark: SparkSession, reference: str, target: str, mode: str = "auto") -> Analysis:
    """The analysis of the first chains of two structure files."""
    if mode == "manual":
        raise ValueError("manual mode needs a table of pairs: operators.correspondence.manual_mapping")
    sides = []
    for path in (reference, target):
        raw = structures.read(spark, path)
        rows = structures.residues(raw)
        chain = structures.select_chain(structures.chains(rows)).limit(1).cache()
        own = rows.join(chain.select("structure_id", "model_id", "chain_id"), ["structure_id", "model_id", "chain_id"])
        sides.append((chain, own, structures.atoms(raw)))
    ids = []
    for (chain, _, _), path in zip(sides, (reference, target), strict=True):
        if not (row := chain.first()):
            raise ValueError(f"no chain in {path}")
        ids.append(row["structure_id"])
    if ids[0] == ids[1]:
        # The same name twice: the target is told apart.
        ids[1] += " (target)"
        sides[1] = tuple(df.withColumn("structure_id", F.lit(ids[1])) for df in sides[1])
        sides[1] = (sides[1][0], *(df.withColumn("residue_key", F.concat(F.lit("target:"), "residue_key")) for df in sides[1][1:]))
    chains, residues, atoms = (a.unionByName(b) for a, b in zip(*sides, strict=True))
    places = residues.join(atoms.filter("name = 'CA'").select("residue_key", "x", "y", "z"), "residue_key", "left")
    pairs = spark.createDataFrame([("pair", *ids)], "pair_id string, reference_id string, target_id string")
    # Two files: what is read and aligned is kept for all that is asked of it.
    a = Analysis.of_sequences(pairs, chains, places.cache(), atoms.cache())
    return Analysis(a.alignments.cache(), a.residues, a.atoms)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foldframe")
    commands = parser.add_subparsers(dest="command", required=True)
    own = commands.add_parser("compare", help="compare the first chains of two structure files")
    own.add_argument("reference")
    own.add_argument("target")
    own.add_argument("--mode", choices=["auto", "sequence", "structure", "manual"], default="auto")
    own.add_argument("--output", help="write a workbook")
    own.add_argument("--csv", help="write the residues as CSV")
    own.add_argument("--json", help="write the summary as JSON")
    said = parser.parse_args(args)
    spark = SparkSession.builder.appName("foldframe").getOrCreate()
    try:
        a = compare(spark, said.reference, said.target, said.mode)
        summary = a.summary(refined=True, mode=said.mode).cache()
        s = summary.first()
        length = lambda x: "n/a" if x is None else f"{x:.3f} Å"
        for name, value in (
            ("Reference", s["reference_id"]), ("Target", s["target_id"]), ("Sequence identity", f"{s['identity']:.3f}"), ("Sequence coverage", f"{s['coverage']:.3f}"),
            ("Strict Cα RMSD", length(s["strict_rmsd"])), ("Refined Cα RMSD", length(s["refined_rmsd"])), ("Mapped residues", s["mapped_count"]), ("Mutations", s["mutation_count"]), ("Alignment", s["decision"]),
        ):
            print(f"{name}: {value}")
        sheets = reports.pair_sheets(a, refined=True)
        rows = sheets["Residues"]
        if said.output:
            sinks.write_workbook(sheets, said.output)
        if said.csv:
            sinks.write_csv(rows, said.csv)
        if said.json:
            with open(said.json, "w", encoding="utf-8") as f:
                f.write(sinks.as_json(summary).first()["value"])
        return 0
    except (PySparkException, OSError, ValueError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
