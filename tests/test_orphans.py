import datetime as dt

from ephysloom.functions.keys import entity_key
from ephysloom.operators.orphans import Ref, orphan_cascade, orphan_report

T = lambda y: dt.datetime(y, 1, 1)


def _cascade(spark, n_chain=130):
    # p0 names a parent that is missing, each next one names the one before
    people = [(i, f"P{i}", f"P{i - 1}" if i else "GONE", T(2000)) for i in range(n_chain)] + [(900, "Q", None, T(2000)), (901, "LOOP", "loop", T(2000)), (901, "LOOP", "loop", T(2000))]
    p = spark.createDataFrame([(*r, "x") for r in people], "row_id long, pid string, prior string, at timestamp_ntz, depth string")
    things = [(1, "Q", "A1", None, None), (2, "Q", "A-2", T(2010), T(2012)), (3, "Q", "a2", T(2014), None), (4, "P0", "B1", None, None), (5, "P7", "B1", None, None), (6, "NONE", "C1", None, None)]
    t = spark.createDataFrame(things, "row_id long, pid string, name string, lo timestamp_ntz, hi timestamp_ntz")
    uses = [
        (1, "q", "a01", T(2011)), (2, "q", "A2", T(2011)), (3, "q", "A2", T(2013)), (4, "q", "A2", T(2009)), (5, "q", "A2", None), (6, "q", "zz", T(2011)),
        (7, "P0", "b1", T(2011)), (8, "P7", "B1", T(2011)), (9, "NONE", "C1", T(2011)), (10, None, "A1", T(2011)), (11, "q", "  ", T(2011)), (6, "q", "zz", T(2011)), (12, "q", "A1", None),
    ]
    u = spark.createDataFrame(uses, "row_id long, pid string, name string, at timestamp_ntz")
    refs = [
        Ref("prior", "people", ["prior"], "people", ["pid"], entity_key, "at"),
        Ref("person", "things", ["pid"], "people", ["pid"], entity_key, "lo"),
        Ref("thing", "uses", ["pid", "name"], "things", ["pid", "name"], entity_key, "at", ("lo", "hi")),
    ]
    return orphan_cascade({"people": p, "things": t, "uses": u}, refs)


def test_cascade(spark):
    o = _cascade(spark, 20)
    got = {(r.child_table, r.row_id): (r.kind, r.reason, r.depth) for r in o.collect()}
    assert len(got) == o.count()
    assert {k: v for k, v in got.items() if k[0] == "people"} == {("people", i): ("direct", "never", 0) if i == 0 else ("inherited", "parent", i) for i in range(20)}
    assert {k[1]: v for k, v in got.items() if k[0] == "things"} == {4: ("inherited", "parent", 1), 5: ("inherited", "parent", 8), 6: ("direct", "never", 0)}
    assert {k[1]: v for k, v in got.items() if k[0] == "uses"} == {
        3: ("direct", "between", 0), 4: ("direct", "later", 0), 5: ("direct", "undated", 0), 6: ("direct", "never", 0),
        7: ("inherited", "parent", 2), 8: ("inherited", "parent", 9), 9: ("inherited", "parent", 1),
    }
    assert sum(r.n_rows for r in orphan_report(o).collect()) == len(got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "row_id long, k string")
    some = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "row_id long, k string")
    ref = [Ref("r", "c", ["k"], "p", ["k"])]
    assert orphan_cascade({"p": none, "c": none}, ref).count() == 0
    assert [r.row_id for r in orphan_cascade({"p": none, "c": some}, ref).collect()] == [1]
    assert orphan_cascade({"p": some, "c": some}, ref).count() == 0
