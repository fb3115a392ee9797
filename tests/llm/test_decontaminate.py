from __future__ import annotations

from foldframe.llm import decontaminate
from foldframe.llm.decontaminate import contamination, decontaminated, op4_benchmark_decontamination
from foldframe.llm.queries import ORACLE_SQL, QUERIES


def test_sql(agree):
    agree(QUERIES["op4_benchmark_decontamination"], ORACLE_SQL["op4_benchmark_decontamination"])


def test_edges(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Short, item!"), (5, item), (None, "lone"), (1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [
            (1, "Ah: One, two -- three four five six seven eight nine TEN! zwölf", "k"),
            (2, "shortitem short items short itém", "k"),
            (3, "a short item, lone", "k"),
            (4, None, "k"),
            (5, "", "k"),
            (5, "", "k"),
            (None, f"x {item} y", "k"),
        ],
        "doc_id bigint, text string, n_words string",
    )
    for size in (decontaminate.AUTOMATON_BYTES, 20):
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", size)
        rows = contamination(docs, bench, with_spans=True).collect()
        got = sorted([(r.doc_id, r.n_words, list(r._hit), list(r._items), [tuple(s) for s in r.hit_spans]) for r in rows], key=str)
        text = docs.filter("doc_id = 1").first().text
        assert got == sorted(
            [
                (1, 12, list(range(1, 11)), ["1", "5"], [(4, text.index("TEN") + 3)]),
                (2, 5, [], [], []),
                (3, 4, [1, 2, 3], ["", "4"], [(2, 18)]),
                (4, 0, [], [], []),
                (5, 0, [], [], []),
                (5, 0, [], [], []),
                (None, 13, list(range(1, 12)), ["1", "5"], [(2, 2 + len(item))]),
            ],
            key=str,
        )
    assert sorted(r.doc_id for r in decontaminated(docs, bench).collect()) == [2, 4, 5, 5]
    assert decontaminated(docs, bench).columns == docs.columns
    assert decontaminated(docs, bench.limit(0)).count() == 7
    assert op4_benchmark_decontamination(docs.limit(0), bench).count() == 0


def test_whole_table_beyond_one_automaton(spark, monkeypatch):
    """Both forms give the same rows over the whole tables, with few bits too; the large one has a single Python stage over documents."""
    from tests.conftest import SF

    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted(map(tuple, op4_benchmark_decontamination(docs, bench).collect()))
    want = rows()
    assert sum(r[2] > 0 for r in want) > 10
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 1000)
    assert rows() == want
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 12)
    assert rows() == want


def test_large_benchmark(spark):
    """Several MB of items: a window of each is found where it's planted."""
    import random

    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(300))) for i in range(3000)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"before it {' '.join(t.split()[40:52]).upper()} and after" if i % 2 else f"nothing of {i}") for i, t in items[:400]], "doc_id bigint, text string")
    assert sum(len(t) for _, t in items) > 10 * decontaminate.AUTOMATON_BYTES
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in op4_benchmark_decontamination(docs, bench).collect()}
    assert got == {i: (12, 1, True) if i % 2 else (0, 0, False) for i in range(400)}
