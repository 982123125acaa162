from ephysloom.llm import splits
from ephysloom.session import Scratch


def test_components_of_a_chain_a_star_and_a_single(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    links = spark.createDataFrame([*chain, ("s1", "s2"), ("s3", "s2"), ("s2", "s2"), (None, "s1")], "a string, b string")
    nodes = spark.createDataFrame([("lone",)], "node string")
    got = {r.node: r.root for r in splits.components(nodes, links, Scratch(spark)).collect()}
    assert len(got) == 41 + 3 + 1
    roots = [{got[n] for n in got if n[0] == x} for x in "csl"]
    assert [len(r) for r in roots] == [1, 1, 1] and len(set.union(*roots)) == 3
    assert got["lone"] == "lone"


def test_files_link_their_patients(spark):
    used = spark.createDataFrame([("x", "f"), ("y", "f"), ("z", None), ("y", "g"), ("w", "g")], "node string, f string")
    assert {tuple(r) for r in splits.star_links(used, "node", "f").collect()} == {("x", "y"), ("w", "y")}


def test_deal_keeps_the_shares(spark):
    sizes = spark.createDataFrame([(f"r{i}", 1 + i % 7) for i in range(2000)], "root string, n long")
    d = splits.deal(sizes, [("train", 0.8), ("validation", 0.1), ("test", 0.1)])
    n = {r.split: r.n for r in sizes.join(d, "root").groupBy("split").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    total = sum(n.values())
    assert abs(n["train"] / total - 0.8) < 0.02 and abs(n["test"] / total - 0.1) < 0.02


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "a string, b string")
    lone = spark.createDataFrame([("x",), ("x",), (None,)], "node string")
    assert [tuple(r) for r in splits.components(lone, none, Scratch(spark)).collect()] == [("x", "x")]
    d = splits.deal(spark.createDataFrame([], "root string, n long"), [("train", 0.8), ("test", 0.2)])
    assert d.count() == 0


def test_random_graphs_against_union_find(spark):
    import random

    rng = random.Random(2)
    links = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    got = {r.node: r.root for r in splits.components(spark.createDataFrame([("n0",)], "node string"), spark.createDataFrame(links, "a string, b string"), Scratch(spark)).collect()}
    nodes = {x for l in links for x in l} | {"n0"}
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in nodes for b in list(nodes)[:40])


def test_the_links_taken_are_a_spanning_forest(spark):
    import random

    rng = random.Random(3)
    links = list({tuple(sorted((f"n{rng.randrange(120)}", f"n{rng.randrange(120)}"))) for _ in range(160)})
    of, forest = splits.spanning_forest(spark.createDataFrame([("alone",)], "node string"), spark.createDataFrame(links, "a string, b string"), Scratch(spark))
    root = {r.node: r.root for r in of.collect()}
    edges = [(r.a, r.b) for r in forest.collect()]
    assert len(edges) == len(set(edges)) == len(root) - len(set(root.values()))
    assert set(edges) <= set(links) and all(root[a] == root[b] for a, b in edges)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        assert find(a) != find(b)  # no cycle
        up[find(a)] = find(b)


def test_large_components_are_balanced(spark):
    rows = [("hot", 450), *[(f"m{i}", 40 + i) for i in range(30)], *[(f"s{i}", 1) for i in range(1500)], (None, 1)]
    sizes = spark.createDataFrame([(r, n, "x") for r, n in rows], "root string, n long, split string")
    got = splits.deal(sizes, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()
    assert sorted(r.root or "" for r in got) == sorted(r or "" for r, _ in rows)
    of, total = dict(rows), sum(n for _, n in rows)
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(of[r.root] for r in got if r.split == name) / total - share) < 0.01
