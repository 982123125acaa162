import itertools

from ephysloom.llm.mapping import map_entries, repair

REFERENCE = [
    (1, "HippAnt_R", "R", "anterior hippocampus", "hippocampe antérieur", "vorderer Hippocampus"),
    (2, "HippAnt_L", "L", "anterior hippocampus", "hippocampe antérieur", "vorderer Hippocampus"),
    (3, "HippPost_R", "R", "posterior hippocampus", "hippocampe postérieur", "hinterer Hippocampus"),
    (4, "HippPost_L", "L", "posterior hippocampus", "hippocampe postérieur", "hinterer Hippocampus"),
    (5, "DorsPMC_R", "R", "dorsal premotor band", "bandeau prémoteur dorsal", "dorsales Prämotorband"),
    (6, "DorsPMC_L", "L", "dorsal premotor band", "bandeau prémoteur dorsal", "dorsales Prämotorband"),
    (7, "UncusTip_L", "L", "uncal tip", "pointe de l'uncus", "Uncusspitze"),
    (8, "UncusTip_R", "R", "uncal tip", "pointe de l'uncus", "Uncusspitze"),
]
COLUMNS = "shaft_id long, shaft_label string, side string, region_en string, region_fr string, region_de string"

CASES = {
    "HippAnt_R": 1,
    "hippant-l07": 2,
    "  hipp  ant  L  7 ": 2,
    "HipAntL": 2,
    "HIPPPSOT R 3": 3,
    "posterior hippocampus, left 4": 4,
    "hippocampus posterior (right)": 3,
    "post. hippo. l": 4,
    "HIPPOCAMPE ANTERIEUR DROIT, PLOT 2": 1,
    "dorsales Praemotorband li. Kontakt 6": 6,
    "dorsales Pra\u0308motorband re.": 5,
    "dorsl premotor band right": 5,
    "pointe de l'uncus droit, plot 5": 8,
    "R uncal tip": 8,
    "HippAnt": 0,
    "left hippocampus": 0,
    "uncal tip left right": 0,
    "photodiode 3": 0,
    "N/A": 0,
    "??": 0,
    "left": 0,
    "hippant l " + "and much more text that names nothing " * 3000: 0,
}


def test_cases(spark):
    ref = spark.createDataFrame(REFERENCE, COLUMNS).withColumnRenamed("side", "side")
    rows = [(n, t, "x") for n, t in enumerate(CASES)]
    rows += [(900, None, "x"), (901, "   ", "x"), (None, "HippAnt_R", "x"), (0, "HippAnt_R", "x")]
    e = spark.createDataFrame(rows, "entry_id long, electrode string, score string")
    got = {r.entry_id: r.reference_id for r in map_entries(e, ref).collect()}
    assert got == {n: want for n, want in enumerate(CASES.values())}
    assert set(r.reference_id for r in map_entries(e, ref.limit(0)).collect()) == {0}
    assert map_entries(e.limit(0), ref).count() == 0


def _within_one(a: str, b: str) -> bool:
    cut = lambda x: {x} | {x[:i] + x[i + 1 :] for i in range(len(x))}
    return bool(cut(a) & cut(b))


def test_repair_against_all_pairs(spark):
    tokens = ["temporal", "tempral", "temopral", "xemporal", "hippo", "ins", "dors", "uncsu", "brainstem", "l", "le"]
    words = ["temporal", "temporale", "hippocampus", "insula", "dorsal", "uncus", "left", "l"]
    t = spark.createDataFrame([(x,) for x in tokens], "token string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    got = {(r.token, r.word) for r in repair(t, w).collect()}
    want = set()
    for a, b in itertools.product(tokens, words):
        if a == b or (min(len(a), len(b)) >= 4 and _within_one(a, b)) or (len(a) >= 3 and a != b and b.startswith(a)):
            want.add((a, b))
    assert got == want
