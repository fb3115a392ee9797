"""Multiple sequence alignments: rows, cells, columns and their statistics."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldframe.functions.lookups import AMBIGUOUS, CANONICAL
from foldframe.operators.alignment import gotoh

FULL_INFORMATION = math.log2(20)


def parse_aligned(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Checked aligned rows (alignment_id, identifier, sequence) against expected (alignment_id, identifier, seq_ord).

    Missing, unexpected or repeated identifiers and rows of unequal width are errors.
    """
    both = rows.groupBy("alignment_id", "identifier").agg(F.count(F.lit(1)).alias("n"), F.first("sequence").alias("sequence")).join(expected, ["alignment_id", "identifier"], "full_outer")
    whole = Window.partitionBy("alignment_id")
    both = both.withColumn("narrow", F.min(F.length("sequence")).over(whole)).withColumn("wide", F.max(F.length("sequence")).over(whole))
    checks = (
        F.assert_true(F.col("sequence").isNotNull(), F.concat(F.lit("missing row: "), "identifier")).isNull()
        & F.assert_true(F.col("seq_ord").isNotNull(), F.concat(F.lit("unexpected row: "), "identifier")).isNull()
        & F.assert_true(F.col("n") == 1, F.concat(F.lit("repeated row: "), "identifier")).isNull()
        & F.assert_true(F.col("narrow") == F.col("wide"), F.lit("rows differ in width")).isNull()
    )
    return both.filter(checks).select("alignment_id", "seq_ord", "identifier", F.upper("sequence").alias("row"))


def against_first(sequences: list[str]) -> list[str]:
    """Rows by matching blocks with the first sequence; shorter rows are filled up with gaps at the right end."""
    width, rows = len(sequences[0]), [sequences[0]]
    for other in sequences[1:]:
        row = []
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(a=sequences[0], b=other, autojunk=False).get_opcodes():
            row.append(other[j1:j2] if tag in ("equal", "insert") else other[j1:j2].ljust(max(i2 - i1, j2 - j1), "-"))
        rows.append("".join(row))
        width = max(width, len(rows[-1]))
    return [r.ljust(width, "-") for r in rows]


def center_star(sequences: list[str]) -> list[str]:
    """Rows by aligning each sequence to the first and giving every insertion columns of its own place."""
    first = sequences[0]
    pairs = [gotoh(first, s)[:2] for s in sequences[1:]]
    room = [0] * (len(first) + 1)
    for a, _ in pairs:
        at = run = 0
        for c in a + "x":
            if c == "-":
                run += 1
            else:
                room[at] = max(room[at], run)
                at, run = at + 1, 0
    rows = ["".join("-" * room[i] + c for i, c in enumerate(first)) + "-" * room[-1]]
    for a, b in pairs:
        out, at, run = [], 0, ""
        for c, d in zip(a + "x", b + "x", strict=True):
            if c == "-":
                run += d
            else:
                out.append(run.ljust(room[at], "-") + (d if at < len(first) else ""))
                at, run = at + 1, ""
        rows.append("".join(out))
    return rows


def align(sequences: DataFrame, mode: str = "fallback") -> DataFrame:
    """(alignment_id, seq_ord, structure_id, sequence) -> those with row; the lowest seq_ord is the reference. mode: fallback or center_star.

    A group is one alignment, whose sequences one task holds.
    """
    build = {"fallback": against_first, "center_star": center_star}[mode]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq_ord")
        return group.assign(row=build(group.sequence.str.upper().tolist()))

    own = sequences.select("alignment_id", "seq_ord", "structure_id", "sequence")
    return own.groupBy("alignment_id").applyInPandas(run, "alignment_id string, seq_ord int, structure_id string, sequence string, row string")


def cells(rows: DataFrame) -> DataFrame:
    """(alignment_id, seq_ord, structure_id, row) -> a row for each character: column_index, character and seq_index (null at gaps). '.' counts as '-'."""
    chars = F.split(F.upper(F.translate("row", ".", "-")), "")
    out = rows.select("alignment_id", "seq_ord", "structure_id", F.posexplode(chars).alias("column_index", "character"))
    run = Window.partitionBy("alignment_id", "seq_ord").orderBy("column_index").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum((F.col("character") != "-").cast("int")).over(run).cast("int") - 1
    return out.withColumn("seq_index", F.when(F.col("character") != "-", seen))


def letter_counts(cell_rows: DataFrame) -> DataFrame:
    """alignment_id, column_index, character, n, canonical (their number in the column), frequency of each canonical letter."""
    own = cell_rows.filter(F.col("character").isin(*CANONICAL)).groupBy("alignment_id", "column_index", "character").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("alignment_id", "column_index"))
    return own.withColumn("canonical", total).withColumn("frequency", F.col("n") / F.col("canonical"))


def conservation(cell_rows: DataFrame) -> DataFrame:
    """Per column: non_gap_count, gap_fraction, ambiguous_fraction, entropy_bits and conservation (null below two canonical letters)."""
    whole = cell_rows.groupBy("alignment_id", "column_index").agg(
        F.count_if(F.col("character") != "-").alias("non_gap_count"), F.avg((F.col("character") == "-").cast("int")).alias("gap_fraction"), F.avg(F.col("character").isin(*AMBIGUOUS).cast("int")).alias("ambiguous_fraction")
    )
    letters = letter_counts(cell_rows).groupBy("alignment_id", "column_index").agg(F.sum(F.col("frequency") * F.log2("frequency")).alias("plogp"), F.sum("n").alias("canonical"))
    entropy = F.when(F.col("canonical") >= 2, F.lit(0.0) - F.col("plogp"))
    out = whole.join(letters, ["alignment_id", "column_index"], "left").withColumn("entropy_bits", entropy)
    return out.withColumn("conservation", 1.0 - F.col("entropy_bits") / FULL_INFORMATION).drop("plogp", "canonical")


def logo(cell_rows: DataFrame) -> DataFrame:
    """Height of each canonical letter: its frequency times the column's information; columns of fewer than two have none."""
    entropy = conservation(cell_rows).filter("entropy_bits is not null").select("alignment_id", "column_index", "entropy_bits")
    return letter_counts(cell_rows).join(entropy, ["alignment_id", "column_index"]).select("alignment_id", "column_index", "character", (F.col("frequency") * (FULL_INFORMATION - F.col("entropy_bits"))).alias("height"))


def frequency_sheet(cell_rows: DataFrame) -> DataFrame:
    """A row for each column with the frequency of each of the twenty letters, 0.0 where absent."""
    wide = letter_counts(cell_rows).groupBy("alignment_id", "column_index").pivot("character", list(CANONICAL)).agg(F.first("frequency"))
    return wide.fillna(0.0)


def column_labels(cell_rows: DataFrame, reference_labels: DataFrame) -> DataFrame:
    """reference_label of each column: the reference residue's, or that of the last one before with +n, N+n before the first.

    reference_labels: alignment_id, seq_index, label, residue_key of the first row's residues; without one a column is labelled seq:n.
    """
    first = cell_rows.join(cell_rows.groupBy("alignment_id").agg(F.min("seq_ord").alias("seq_ord")), ["alignment_id", "seq_ord"])
    named = first.join(reference_labels, ["alignment_id", "seq_index"], "left")
    own = F.when(F.col("seq_index").isNotNull(), F.coalesce("label", F.concat(F.lit("seq:"), (F.col("seq_index") + 1).cast("string"))))
    run = Window.partitionBy("alignment_id").orderBy("column_index").rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("own", own).withColumn("island", F.count("own").over(run)).withColumn("last", F.last("own", ignorenulls=True).over(run))
    ordinal = F.row_number().over(Window.partitionBy("alignment_id", "island").orderBy("column_index"))
    nth = F.when(F.col("island") == 0, ordinal).otherwise(ordinal - 1)
    label = F.coalesce("own", F.concat(F.coalesce("last", F.lit("N")), F.lit("+"), nth.cast("string")))
    return named.select("alignment_id", "column_index", label.alias("reference_label"), F.col("residue_key").alias("reference_key"))


def columns(cell_rows: DataFrame, reference_labels: DataFrame) -> DataFrame:
    """The columns of an alignment with labels and statistics."""
    return column_labels(cell_rows, reference_labels).join(conservation(cell_rows), ["alignment_id", "column_index"])


def insertions(cell_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of residues where the reference has a gap: alignment_id, reference_label, structure_id, character."""
    gaps = labels.filter("reference_label rlike '[+][0-9]+$'").select("alignment_id", "column_index", "reference_label")
    return cell_rows.filter("character <> '-'").join(gaps, ["alignment_id", "column_index"]).select("alignment_id", "column_index", "reference_label", "structure_id", "character")
