import numpy as np
import pytest

from ephysloom.llm.leakage import Leaks, align, common_subsequence, find_leaks, most_matches, places

WORDS = [f"{a}{b}{c}x" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def _doc(passage):
    return np.concatenate([np.zeros(30, np.int32), passage, np.zeros(30, np.int32)])


@pytest.mark.parametrize("kind", ["every third exchanged", "pieces of seven"])
def test_thin_passages_are_found(kind):
    rng = np.random.default_rng(5)
    found = Leaks([(n, " ".join(rng.permutation(WORDS)[:60])) for n in range(20)])
    for n, item in enumerate(found.items):
        p = item[10:40].copy()
        if kind == "every third exchanged":
            p[2::3] = 0
        else:
            p = np.concatenate([np.append(p[k : k + 7], np.zeros(8, np.int32)) for k in range(0, 28, 7)])
        assert n in {i for i, _ in found.leaks([_doc(p)])[0]}


def test_dense_part_matches_as_many_words():
    rng = np.random.default_rng(6)
    found = Leaks([(0, " ".join(WORDS[:60]))])
    item = found.items[0]
    for _ in range(50):
        a = item[5:35].copy()
        a[rng.random(30) < 0.25] = 0
        doc = np.concatenate([rng.choice(np.append(item, np.zeros(150, np.int32)), 200), a, rng.choice(np.append(item, np.zeros(150, np.int32)), 200)]).astype(np.int32)
        got = found.stretches(doc, np.array([0]))
        whole = found.matched(doc, item)
        kept = max((found.matched(runs, item) for _, runs in got), default=0)
        assert kept >= whole if whole >= found.least_words else True


def test_most_matches_is_the_alignments():
    rng = np.random.default_rng(8)
    items = [rng.integers(1, 30, rng.integers(5, 40)).astype(np.int32) for _ in range(60)]
    docs = [rng.integers(0, 30, rng.integers(1, 80)).astype(np.int32) for _ in items]
    for d, i in zip(docs, items, strict=True):
        if len(d) > 30:
            d[10:20] = i[:10] if len(i) >= 10 else d[10:20]
    got = most_matches(items, docs)
    for k, (i, d) in enumerate(zip(items, docs, strict=True)):
        p = align(i, d)
        assert got[k] >= (len(p) if p else 0)
        assert got[k] <= common_subsequence(d, places(i), len(i))


def test_common_subsequence_against_the_table():
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, b = rng.integers(1, 9, 40), rng.integers(1, 9, 60)
        t = np.zeros((41, 61), int)
        for i in range(40):
            for j in range(60):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert common_subsequence(b, places(a), 40) == t[40, 60]


def test_long_stretches_are_searched_in_windows():
    found = Leaks([(0, " ".join(WORDS[:60]))])
    item = found.items[0]
    rng = np.random.default_rng(10)
    doc = rng.permutation(np.repeat(item, 40)).astype(np.int32)
    doc[1500:1530] = item[10:40]
    assert found.leaks([doc])[0][0][1] >= 28


def test_null_empty_and_repeated_texts(spark):
    item = " ".join(WORDS[:40])
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, item, "x"), (5, item, "x"), (5, item, "x"), (6, "lorem " * 20000, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "short text")], "item_id long, item_text string")
    for block in (500, 1):
        got = {tuple(r)[:2] for r in find_leaks(docs, items, block=block).collect()}
        assert got == {(4, 7), (4, 8), (5, 7), (5, 8)}
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
