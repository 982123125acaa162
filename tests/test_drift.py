import json

from ephysloom.operators import drift

ODD = [
    '{"a": 1, "b": 2.5, "c": "x", "d": true, "e": null}',
    '{"a": 1.2.3, "d": 2024-01-01}',
    '{"a": 01}',
    '{"a": 1,}',
    '{"a" : -0.5e3 , "A": 1e5}',
    '{"trial": {"end": 5, "deep": {"x": "y"}}, "l": [1, 2]}',
    '{"a": NaN}',
    '{"q": "he said \\"no\\"", "u": "\\u00e9"}',
    '{"a": 1, "a": "two"}',
    "{}",
    "",
    "  {  }  ",
    "[1, 2]",
    "nonsense",
    '{"a": "line\nbreak"}',
    None,
]


def _leaves(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "i long, payload string, name string")
    return {r.i: [tuple(x) for x in r.leaves] for r in drift.path_values(df, ["i"]).collect()}


def test_both_parsers_agree(spark):
    got = _leaves(spark, ODD)
    for i, p in enumerate(ODD):
        assert got[i] == drift.flatten_json(p), p


def test_wide_and_long_payloads(spark):
    wide = json.dumps({f"field_{i}": i / 4 for i in range(10_000)})
    long = json.dumps({"a": "y" * 2_000_000})
    got = _leaves(spark, [wide, long])
    assert len(got[0]) == 10_000 and len(got[1][0][1]) == 2_000_000


def _changes(spark, files):
    rows = [("s", f, n, p, "2024-01-0%d" % f) for f, ps in files.items() for n, p in enumerate(ps)]
    t = spark.createDataFrame(rows, "series string, file long, line int, payload string, written string")
    known = spark.createDataFrame([("trial_end", "trial_end"), ("trial_end", "TrialEnd"), ("trial_end", "end_sample")], "field string, known_name string")
    stats = drift.field_stats(drift.path_values(t, ["series", "file"]), ["series", "file"], known)
    return {(r.file, r.field, r.change) for r in drift.schema_changes(stats, drift.file_order(t, "series", "file", "written"), "series", "file").collect()}


def test_changes_between_files(spark):
    got = _changes(
        spark,
        {
            1: ['{"trial_end": 5, "x": 1}', '{"trial_end": 6, "x": 1}', '{"trial_end": 6, "x": 1}'],
            2: ['{"Trial-End": 5, "x": 1.0}'],
            3: ['{"end_sample": "7", "y": null}', None],
            4: [""],
            5: ['{"trial": {"end": 5}, "y": 2}'],
        },
    )
    assert got == {(2, "x", "retyped"), (3, "trial_end", "renamed"), (3, "trial_end", "retyped"), (3, "x", "removed"), (3, "y", "added"), (4, "trial_end", "removed"), (4, "y", "removed"), (5, "trial", "added"), (5, "y", "added")}


def test_typed_rows(spark):
    known = spark.createDataFrame([("n", "n"), ("n", "num"), ("g", "g")], "field string, known_name string")
    ps = ['{"N": "1,250 ms", "g": "2,5"}', '{"num": 3.0, "g": "bad", "z": {"k": 1}}', '{"n": 3.5}', "broken", None]
    df = spark.createDataFrame(list(enumerate(ps)) + [(0, ps[0])], "i long, payload string")
    out = {r.i: r for r in drift.typed_rows(drift.path_values(df, ["i"], once=True), ["i"], known, {"n": "long", "g": "double"}).collect()}
    assert (out[0].n, out[0].g, out[0].failed) == (1250, 2.5, [])
    assert (out[1].n, out[1].g, out[1].failed) == (3, None, ["g=bad"]) and json.loads(out[1].extra) == {"z": '{"k": 1}', "z.k": "1"}
    assert (out[2].n, out[2].failed) == (None, ["n=3.5"])
    assert out[3].n is None and out[4].n is None and len(out) == 5
