from ephysloom.llm.quality import label_shares, not_prose, text_stats, train


def test_word_order_is_counted_on_every_line_of_every_document(spark):
    words = "the of and to in on at by".split()
    texts = ["\n".join(" ".join(words[(i + j + k * (1 + j % 3)) % 8] for k in range(9)) for j in range(12)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common = {"en": set(words)}
    whole, sampled = train(docs, common), train(docs, common, sample_docs=5, lines_per_doc=3)
    assert whole.order.table["en"] == sampled.order.table["en"]


PROSE = "The electrode was placed on the left side of the head and the recording was stable for most of the night. We did not see any change in the signal, and the patient slept well until the morning."
LISTED = "- gauze\n- tape\n- saline\n- gloves\n- forceps\n- drapes\n- suture\n- scalpel"
TABLE = "\n".join(f"| {i} | {i * 3.5:.1f} | {i * i} | ok |" for i in range(12))
LOG = "\n".join(f"2024-01-01 10:00:{i:02d} [INFO] 0x{i:04x} node=7 retry={i}" for i in range(12))
WORDS = ["the", "of", "and", "to", "in", "was", "on", "for", "we", "any", "did", "not", "is", "at", "by"]


def _docs(spark):
    rows = [(i, f"{PROSE} It was day {i}.\n{PROSE}") for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate([LISTED, TABLE, LOG] * 10)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, PROSE * 400), (904, PROSE), (904, PROSE), (905, "> " + PROSE.replace(". ", ".\n> ")), (906, PROSE + "\n" + LISTED[:20])]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string")


def test_prose_against_the_rest(spark):
    docs = _docs(spark)
    s = label_shares(docs, train(docs, {"en": set(WORDS)}))
    bad = {r.doc_id for r in s.filter(not_prose(s)).collect()}
    assert bad == set(range(100, 130))
    assert 900 not in {r.doc_id for r in s.collect()}
    assert label_shares(docs.limit(0), train(docs.limit(0), {"en": set(WORDS)})).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat sat.\nno end\n\n"), (2, None), (3, ""), (4, "...")], "doc_id long, text string")
    r = {x.doc_id: x for x in text_stats(df, ["the", "no"]).collect()}
    assert (r[1].n_words, r[1].common_share, r[1].punct_line_share) == (5, 0.4, 0.5)
    assert abs(r[1].mean_word_len - 14 / 5) < 1e-9
    assert r[2].n_words == 0 and r[2].mean_word_len is None and r[3].symbol_share is None and r[4].symbol_share == 1.0
