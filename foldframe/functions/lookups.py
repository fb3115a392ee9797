"""Amino-acid lookups as plain values, Columns and small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------------------

#: Canonical letters in alphabetical order.
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS = "XBZJ"
WATERS = ("HOH", "WAT", "DOD")

THREE_LETTERS = {
    "A": "ALA", "R": "ARG", "N": "ASN", "D": "ASP", "C": "CYS", "Q": "GLN", "E": "GLU", "G": "GLY", "H": "HIS", "I": "ILE",
    "L": "LEU", "K": "LYS", "M": "MET", "F": "PHE", "P": "PRO", "S": "SER", "T": "THR", "W": "TRP", "Y": "TYR", "V": "VAL",
}

# BLOSUM62, lower triangle, in the order of the letters.
BLOSUM62_ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62_ROWS = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
# The ambiguous letters against those twenty and against each other; the stop sign scores -4, with itself 1.
BLOSUM62_AMBIGUOUS = """
B -2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4
Z -1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4
X  0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1
"""

# Grantham's distances (1974), upper triangle, in the order of the letters.
GRANTHAM_ORDER = "SRLPTAVGIFYCHQNKDEMW"
GRANTHAM_ROWS = """
110 145  74  58  99 124  56 142 155 144 112  89  68  46 121  65  80 135 177
102 103  71 112  96 125  97  97  77 180  29  43  86  26  96  54  91 101
 98  92  96  32 138   5  22  36 198  99 113 153 107 172 138  15  61
 38  27  68  42  95 114 110 169  77  76  91 103 108  93  87 147
 58  69  59  89 103  92 149  47  42  65  78  85  65  81 128
 64  60  94 113 112 195  86  91 111 106 126 107  84 148
109  29  50  55 192  84  96 133  97 152 121  21  88
135 153 147 159  98  87  80 127  94  98 127 184
 21  33 198  94 109 149 102 168 134  10  61
 22 205 100 116 158 102 177 140  28  40
194  83  99 143  85 160 122  36  37
174 154 139 202 154 170 196 215
 24  68  32  81  40  87 115
 46  53  61  29 101 130
 94  23  42 142 174
101  56  95 110
 45 160 181
126 152
 67
"""

CATEGORIES = {"nonpolar": "AVLIMPG", "aromatic": "FWY", "polar": "STNQC", "positively_charged": "KRH", "negatively_charged": "DE"}

DONORS = ("N", "NE", "NH1", "NH2", "ND1", "ND2", "NE1", "NE2", "NZ", "OG", "OG1", "OH")
ACCEPTORS = ("O", "OD1", "OD2", "OE1", "OE2", "OG", "OG1", "OH", "N", "ND1", "NE2")
HYDROPHOBIC = ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO")
AROMATIC = ("PHE", "TYR", "TRP", "HIS")
CATIONIC = ("ARG", "LYS", "HIS")
ACIDIC = ("ASP", "GLU")
METALS = ("ZN", "FE", "MG", "MN", "CA", "CU", "CO", "NI")
SITE_POLAR = ("SER", "THR", "ASN", "GLN", "TYR", "HIS")
SITE_CHARGED = ("ARG", "LYS", "ASP", "GLU", "HIS")
BACKBONE = ("N", "CA", "C", "O")
#: (residue, ring): the ring's atoms in order.
RINGS = {
    ("PHE", 0): ("CG", "CD1", "CE1", "CZ", "CE2", "CD2"),
    ("TYR", 0): ("CG", "CD1", "CE1", "CZ", "CE2", "CD2"),
    ("TRP", 0): ("CG", "CD1", "NE1", "CE2", "CD2"),
    ("TRP", 1): ("CD2", "CE2", "CE3", "CZ3", "CH2", "CZ2"),
    ("HIS", 0): ("CG", "ND1", "CE1", "NE2", "CD2"),
}
CATION_GROUPS = {"ARG": ("NE", "CZ", "NH1", "NH2"), "LYS": ("NZ",), "HIS": ("ND1", "NE2")}
#: Atoms that trade names in an equivalent pose; all of a residue's swap together.
SWAPS = {
    "ASP": {"OD1": "OD2"},
    "GLU": {"OE1": "OE2"},
    "ARG": {"NH1": "NH2"},
    "PHE": {"CD1": "CD2", "CE1": "CE2"},
    "TYR": {"CD1": "CD2", "CE1": "CE2"},
}

# ---- Tables made of them ------------------------------------------------------------------------

ONE_LETTER = {three: one for one, three in THREE_LETTERS.items()}
CATEGORY_OF = {letter: name for name, letters in CATEGORIES.items() for letter in letters}


def _blosum62() -> dict[tuple[str, str], int]:
    letters = BLOSUM62_ORDER + "BZX*"
    rows = [[int(x) for x in line.split()] for line in BLOSUM62_ROWS.strip().splitlines()]
    rows += [[int(x) for x in line.split()[1:]] for line in BLOSUM62_AMBIGUOUS.strip().splitlines()]
    rows.append([-4] * 23 + [1])
    return {pair: v for i, row in enumerate(rows) for j, v in enumerate(row) for pair in ((letters[i], letters[j]), (letters[j], letters[i]))}


def _grantham() -> dict[tuple[str, str], int]:
    o, out = GRANTHAM_ORDER, {(a, a): 0 for a in GRANTHAM_ORDER}
    for i, line in enumerate(GRANTHAM_ROWS.strip().splitlines()):
        for j, v in enumerate(map(int, line.split())):
            out[o[i], o[i + 1 + j]] = out[o[i + 1 + j], o[i]] = v
    return out


BLOSUM62 = _blosum62()
GRANTHAM = _grantham()


def substitution_table(spark: SparkSession) -> DataFrame:
    """reference_aa, target_aa, score (24 symbols), blosum62 and grantham (20 letters, else null): 576 rows, to be broadcast."""
    rows = [(a, b, v, v if a in CANONICAL and b in CANONICAL else None, GRANTHAM.get((a, b))) for (a, b), v in sorted(BLOSUM62.items())]
    return spark.createDataFrame(rows, "reference_aa string, target_aa string, score int, blosum62 int, grantham int")


def _mapped(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def one_letter(residue_name: Column) -> Column:
    """Letter of a canonical residue name, else null."""
    return _mapped(F.upper(residue_name), ONE_LETTER)


def category(letter: Column) -> Column:
    """Physicochemical category of a canonical letter in either case, else null."""
    return _mapped(F.upper(letter), CATEGORY_OF)


def substitution_class(reference: Column, target: Column) -> Column:
    """conservative within a category, non_conservative across; null if either letter has none."""
    a, b = category(reference), category(target)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "conservative").otherwise("non_conservative"))


def is_canonical(letter: Column) -> Column:
    """False for null."""
    return F.coalesce(letter.isin(*CANONICAL), F.lit(False))
