"""Query-level API: whole analyses over tables of pairs, residues and atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.operators import correspondence, mutations, superposition
from foldframe.operators.alignment import align_pairs
from foldframe.sources.shared import shared_dir


class Analysis:
    """Everything about some pairs of chains, each table derived when it is asked for.

    alignments: pair_id, reference_id, target_id, aligned_reference,
    aligned_target. residues and atoms: see operators. One pair, one reference
    against many and all against all are the same plan over other pairs.
    """

    def __init__(self, alignments: DataFrame, residues: DataFrame, atoms: DataFrame | None = None) -> None:
        self.alignments, self.residues, self.atoms = alignments, residues, atoms

    @staticmethod
    def of_sequences(pairs: DataFrame, chains: DataFrame, residues: DataFrame, atoms: DataFrame | None = None) -> Analysis:
        """Aligns the sequences of chains (structure_id, sequence) of each pair first."""
        own = chains.select("structure_id", "sequence")
        for side in ("reference", "target"):
            pairs = pairs.join(own.withColumnsRenamed({"structure_id": f"{side}_id", "sequence": f"{side}_sequence"}), f"{side}_id")
        return Analysis(align_pairs(pairs), residues, atoms)

    def kept(self, atoms: bool = True) -> Analysis:
        """The same over tables written once to the shared folder, for results that read them many times.

        atoms: whether these are written too; without, they are derived at each reading. The files go with the tables where spark.cleaner.referenceTracking.cleanCheckpoints is on.
        """
        shared_dir(self.alignments.sparkSession)
        return Analysis(self.alignments.checkpoint(), self.residues.checkpoint(), self.atoms.checkpoint() if atoms and self.atoms is not None else self.atoms)

    def correspondence(self) -> DataFrame:
        return correspondence.with_residues(correspondence.explode_alignments(self.alignments), self.residues)

    def transforms(self) -> DataFrame:
        return superposition.fit(self.correspondence())

    def moved(self) -> DataFrame:
        """Correspondence with target places in the reference's frame and displacements."""
        rows = self.correspondence()
        return superposition.moved(rows, superposition.fit(rows))

    def residue_metrics(self) -> DataFrame:
        """moved() with the residue RMSDs."""
        rows = self.moved()
        each = superposition.residue_rmsd(rows, self.atoms, self.transforms())
        return rows.join(each, ["pair_id", "alignment_index"], "left")

    def mutations(self) -> DataFrame:
        return mutations.detect(self.correspondence())

    def summary(self, refined: bool = False, mode: str = "auto", min_identity: float = 0.30, min_coverage: float = 0.70) -> DataFrame:
        """A row for each pair: sequence metrics, decision, RMSDs, counts; what can't be had is null."""
        rows = self.correspondence()
        out = correspondence.decision(correspondence.sequence_metrics(rows), mode, min_identity, min_coverage)
        out = out.join(superposition.strict_rmsd(superposition.moved(rows, superposition.fit(rows))), "pair_id", "left").join(correspondence.counts(rows), "pair_id", "left")
        if refined:
            out = out.join(superposition.refined(rows).drop("excluded"), "pair_id", "left")
        else:
            out = out.withColumns({"refined_rmsd": F.lit(None).cast("double"), "refined_count": F.lit(None).cast("int")})
        return out.withColumns({"mapped_count": F.coalesce("mapped_count", F.lit(0)), "tm_score": F.lit(None).cast("double")})
