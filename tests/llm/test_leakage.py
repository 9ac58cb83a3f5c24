from vellumine.llm.leakage import PassageIndex, find_leaks, remove_leaks

P = "In 1709 the crooked slate wall measured 712 crates around the ninth vellum map while the wax seal was hoisted by Keldale. Nobody in Eskton traded the mill race near the bitter clock tower until Grunver carried 759 of them."
OTHER = "In 1851 the mended bell rope stitched 154 crates around the lucky toll gate while the clock tower was swept by Crinhil. Nobody in Galby sounded the vellum map beyond the lucky slate wall until Jorver unlocked 907 of them."
HELD = {
    "whole": f"Before. {P} After.",
    "accents and line breaks": "x\n\n> In 1709 the cróoked slate\n> wall meas-\n> ured 712 crates around the NINTH vellum; map while the wax seal was hoisted by Keldale.",
    "sentences turned round": " ".join(reversed(P.split(". "))),
    "small words and synonyms": "During 1709 a crooked slate wall measured 712 boxes around a ninth vellum map as a wax seal got hoisted by Keldale.",
    "slips": "In 1709 the croked slate wall meassured 712 crates arround the ninth velum map while the wax seal was hoisted by Keldale.",
    "sixteen words": "and crooked slate wall measured 712 crates around the ninth vellum map while the wax seal was and more",
}
FREE = {"same shape": OTHER, "short quotation": "They wrote: the ninth vellum map while the wax seal. Then no more.", "other": "Nothing of the kind.", "empty": ""}


def test_cases(spark):
    docs = [(n, t, 1) for n, t in [*HELD.items(), *FREE.items(), ("null", None)]]
    d = spark.createDataFrame(docs, "doc_id string, text string, words int")
    p = spark.createDataFrame([(7, P), (8, None), (9, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(d, p).collect()}
    assert got == {(n, 7) for n in HELD}


def test_repeats_blocks_and_empty_tables(spark):
    d = spark.createDataFrame([(1, P), (1, P), (None, P)], "doc_id long, text string")
    p = spark.createDataFrame([(7, P), (7, P), (8, OTHER)], "item_id long, text string")
    assert find_leaks(d, p).count() == 6
    assert find_leaks(d, p, block_words=10).count() == 6
    assert find_leaks(d.limit(0), p).count() == 0
    assert find_leaks(d, p.limit(0)).count() == 0


def test_spans_are_removed(spark):
    d = spark.createDataFrame([(1, f"Before it. {P} After it.", "k"), (2, "Clean.", "k")], "doc_id long, text string, at string")
    p = spark.createDataFrame([(7, P)], "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in remove_leaks(d, find_leaks(d, p)).collect()}
    assert out[2] == "Clean." and out[1].startswith("Before it. ") and out[1].endswith(" After it.") and "slate" not in out[1]
    assert [r["doc_id"] for r in remove_leaks(d, find_leaks(d, p), whole_documents=True).collect()] == [2]


def test_long_text():
    ix = PassageIndex([(7, P)])
    assert [h[0] for h in ix.scan("Some other words here. " * 50_000 + P)] == [7]


def test_small_words_and_slips_in_short_runs():
    held = [
        "1709 a crooked slate wall measured 712 crates about a ninth vellum map",  # small words exchanged inside, thirteen words
        "Then a crooked slate wall measured 712 crates around the ninth vellum map.",  # a small word exchanged at the edge, twelve words
        "712 crates around the nineth vellum map while a wax seal was hoisted",  # a misspelling and a small word
        "1709 the croked slate wall meassured 712 crates arround the ninth velum map",  # no three content words in a row are right
        "1709 the crooked slate wall measured 712 boxes around a ninth vellum map",  # one other word, two numbers agree
    ]
    free = ["Over 88 the crooked slate wall measured 95 crates around the ninth vellum map.", "Over a crooked slate wall measured 712 crates around the ninth."]
    ix = PassageIndex([(7, P)])
    assert [len(ix.scan(f"Before. {t} After.")) for t in held] == [1] * 5
    assert [ix.scan(t) for t in free] == [[], []]


def test_short_passage_as_a_whole():
    ix = PassageIndex([(7, "The crooked slate wall measured 712 crates around the ninth map.")])
    assert len(ix.scan("He wrote: a croked slate wall measured 712 crates about a ninth map. Then no more.")) == 1
    assert ix.scan("The crooked slate wall measured 713 crates around the ninth map.") == []


def test_every_copy_in_a_document_is_found_and_removed(spark):
    d = spark.createDataFrame([(1, f"Start. {P} Middle. {P} End.", "k")], "doc_id long, text string, run string")
    p = spark.createDataFrame([(7, P)], "item_id long, text string")
    leaks = find_leaks(d, p)
    assert sorted(r["run"] for r in leaks.collect()) == [0, 1]
    text = remove_leaks(d, leaks).first()["text"]
    assert "slate" not in text and text.startswith("Start. ") and "Middle." in text and text.endswith(" End.")


def test_passages_of_small_words():
    small = "It was for us to be with them and not to be without you or me."
    ix = PassageIndex([(7, small), (8, P)])
    hit = ix.scan(f"He said: {small.upper()} And then he left. {P}")
    assert [h[:2] for h in hit] == [(7, 0), (8, 0)]
    assert ix.scan("It was for us to be with them.") == []
    assert ix.scan("It was for us to be with them and not to be there at all.") != []  # twelve words in a row
    assert PassageIndex([(9, "To be or not")]).scan("He asked: to be or not?") != []
