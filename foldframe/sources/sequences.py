"""FASTA files, structural alignment reports, manual pairs and project documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_fasta(files: DataFrame) -> DataFrame:
    """(path, content) -> path, seq_ord, identifier (first word), description (whole header), sequence in upper case."""
    records = files.select("path", F.posexplode(F.slice(F.split(F.concat(F.lit("\n"), "content"), "\n>"), 2, 1 << 30)).alias("seq_ord", "r"))
    header = F.trim(F.regexp_replace(F.split("r", "\n", 2)[0], "\r", ""))
    body = F.upper(F.regexp_replace(F.coalesce(F.get(F.split("r", "\n", 2), F.lit(1)), F.lit("")), "\\s+", ""))
    return records.select("path", "seq_ord", F.split(header, "\\s+")[0].alias("identifier"), header.alias("description"), body.alias("sequence"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_fasta(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def parse_report(files: DataFrame) -> DataFrame:
    """(path, content) of structural alignment reports -> version, names, tm_score (the first), aligned strings, rotation (9) and translation (3).

    Aligned strings are the first two lines of equal length around a marker
    line. What a report doesn't have is null.
    """
    block = "(?m)^([A-Za-z*-]+)\\r?\\n([ .:]+)\\r?\\n([A-Za-z*-]+)\\r?$"
    found = lambda pattern, group=1: F.nullif(F.regexp_extract("content", pattern, group), F.lit(""))
    number = "(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    # Rows of the matrix begin with their number and hold a shift and three factors.
    lines = F.regexp_extract_all("content", F.lit(f"(?m)^\\s*[012]\\s+{number}\\s+{number}\\s+{number}\\s+{number}\\s*$"), F.lit(0))
    last = F.when(F.size(lines) >= 3, F.slice(lines, -3, 3))
    value = lambda i, k: F.split(F.trim(F.get(last, F.lit(i))), "\\s+")[k].try_cast("double")
    a, b = found(block, 1), found(block, 3)
    same = F.length(a) == F.length(b)
    return files.select(
        "path", found("(?i)version\\s+([0-9]+)").alias("version"), found("Name of Structure_1:\\s*(\\S+)").alias("name_1"), found("Name of Structure_2:\\s*(\\S+)").alias("name_2"),
        found(f"TM-score=\\s*{number}").try_cast("double").alias("tm_score"), F.when(same, a).alias("aligned_reference"), F.when(same, b).alias("aligned_target"),
        F.when(last.isNotNull(), F.array(*[value(i, k) for i in range(3) for k in (2, 3, 4)])).alias("rotation"), F.when(last.isNotNull(), F.array(*[value(i, 1) for i in range(3)])).alias("translation"),
    )


def parse_manual_pairs(texts: DataFrame) -> DataFrame:
    """(pair_id, content): a pair a line, ref -> target (also = or ,), # begins a comment; tokens are chain:number[insertion]. A line of another form is an error."""
    lines = texts.select("pair_id", F.posexplode(F.split("content", "\r?\n")).alias("line", "t")).withColumn("t", F.trim(F.regexp_replace("t", "#.*$", ""))).filter("t <> ''")
    token = "([^\\s:]+:-?[0-9]+[A-Za-z]?)"
    pattern = f"^{token}\\s*(?:->|=|,)\\s*{token}$"
    fine = F.assert_true(F.col("t").rlike(pattern), F.concat(F.lit("not a pair: "), "t")).isNull()
    return lines.filter(fine).select("pair_id", F.col("line").alias("pair_ord"), F.regexp_extract("t", pattern, 1).alias("reference_token"), F.regexp_extract("t", pattern, 2).alias("target_token"))


#: Versions of project documents that can be read.
VERSIONS = ("0.1", "0.2", "3.0")
PROJECT = "version string, reference_id string, targets array<string>, key_residues array<string>, settings map<string,string>, analyses array<struct<target_id:string,payload:string>>"


def parse_projects(texts: DataFrame) -> DataFrame:
    """(path, content) of project JSON -> its fields; absent ones are empty, another version is an error."""
    own = texts.select("path", F.from_json("content", PROJECT).alias("p")).select("path", "p.*")
    known = F.assert_true(F.coalesce(F.col("version").isin(*VERSIONS), F.lit(False)), F.lit("unsupported project version")).isNull()
    empty = lambda c, kind: F.coalesce(c, F.lit(None).cast(kind) if kind.startswith("string") else F.array().cast(kind))
    return own.filter(known).withColumns({"targets": empty("targets", "array<string>"), "key_residues": empty("key_residues", "array<string>"), "settings": F.coalesce("settings", F.create_map().cast("map<string,string>"))})


def upsert_analysis(analyses: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new take the place of those of the same target_id."""
    return analyses.join(new.select("target_id"), "target_id", "left_anti").unionByName(new)


def with_key_residue(projects: DataFrame, residue_key: str) -> DataFrame:
    """Adds a key residue once."""
    return projects.withColumn("key_residues", F.array_union("key_residues", F.array(F.lit(residue_key))))
