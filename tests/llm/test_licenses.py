from __future__ import annotations

from foldframe.llm.licenses import GRAMS, TEMPLATES, bigrams, op5_license_scan, scan
from foldframe.llm.queries import ORACLE_SQL, QUERIES


def test_sql(agree):
    agree(QUERIES["op5_license_scan"], ORACLE_SQL["op5_license_scan"])


def _dice(text, name):
    a, t = bigrams(text), GRAMS[name]
    return 2 * sum((a & t).values()) / (sum(a.values()) + sum(t.values()))


def test_edges(spark):
    mit, isc = TEMPLATES["MIT text"], TEMPLATES["ISC"]
    changed = mit.replace("Software", "Program", 3)
    wrapped = "Some words.\n\n" + "\n".join(isc[i : i + 60] for i in range(0, len(isc), 60)) + "\n\nOther words."
    # A line break within a word makes two words.
    near = _dice("\n".join(isc[i : i + 60] for i in range(0, len(isc), 60)), "ISC")
    rows = [
        (1, None), (2, ""), (3, "one"), (4, mit), (5, changed), (6, wrapped), (7, "x\n RELEASED under the -- mit license!\ny"),
        (8, "released under the mit license " * 3000), (9, "MIT License MIT License MIT License"), (4, mit), (None, "Licensed under CC BY-NC 4.0"),
    ]
    docs = spark.createDataFrame([(*r, "old", 0) for r in rows], "doc_id bigint, text string, license string, dice int")
    got = sorted([(r.doc_id, r.license, r.dice and round(r.dice, 9)) for r in scan(docs).collect()], key=str)
    want = [
        (1, None, None), (2, None, None), (3, None, None), (4, "MIT text", 1.0), (5, "MIT text", round(_dice(changed, "MIT text"), 9)), (6, "ISC", round(near, 9)),
        (7, "MIT", 1.0), (8, None, None), (9, None, None), (4, "MIT text", 1.0), (None, "CC-BY-NC-4.0", 1.0),
    ]
    assert got == sorted(want, key=str)
    assert op5_license_scan(docs.limit(0)).count() == 0
