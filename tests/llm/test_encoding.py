import pytest

from vellumine.llm.encoding import LEGACY, SURE, SWAPS, _aligned, learn_chains, mappings_of, repair, repair_encoding, restore_lost

CLEAN = [
    "Für die Gebühr ist die Straße zuständig.", "L’école et le café d’à côté ont gardé la pièce.", "«Ваша квитанция потеряна. Ждите», — ответили.", "Każda żółć gęś.",
    "SÃO BENTO E NÃO MAIS", "PÂTÉ, CÂBLE et ÂGE", "Đường số 21, quận Ã, phường Â.", "Það er Ð og Þ í nafni", "Ÿ, œ, æ and ƒ are on page 7", "© 3 Ångström, ½ price ®.", "Der Zähler zeigt 8 m³",
    "请在3天内缴清报告！", "電気の使用量は7.5kWhで。", "Ο κ. Fenock ζήτησε νέα επισκευή", "31,7 кВт·ч", "Spaß“ sagte", "«СССР»", "ยังไม่พบใบเสร็จ", "plain ASCII",
]
ROUND = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("cp1250", "utf-8")]
CHAINS = SURE + LEGACY + [x for x in SWAPS if x in [("cp1252", "cp1250"), ("cp1251", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "koi8-r")]]


@pytest.mark.parametrize("text", CLEAN)
def test_right_text_is_left_alone(text):
    assert repair(text, CHAINS) == (text, False)


@pytest.mark.parametrize("wrong,right", ROUND)
def test_round_trip(wrong, right):
    text = "Für die Gebühr ist die Straße zuständig."
    assert repair(text.encode(right).decode(wrong), CHAINS) == (text, True)


def test_layers_and_legacy():
    text = "Mañana pagaré la pensión"
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert repair(twice, CHAINS) == (text, True)
    russian = "Когда придёт батарея под номером 945?"
    assert repair(russian.encode("cp1251").decode("cp1252"), CHAINS) == (russian, True)
    japanese = "点検表の金額は950円です。"
    assert repair(japanese.encode("euc_jp").decode("latin-1"), CHAINS)[1]
    polish = "Ta księga zginęła. Proszę przesłać"
    assert repair(polish.encode("cp1250").decode("cp1252"), CHAINS) == (polish, True)


def test_table(spark):
    t = "Für die Gebühr ist die Straße zuständig."
    rows = [(1, t), (2, t.encode().decode("cp1252")), (3, None), (4, ""), (5, "f�r"), (6, t), (6, t), (None, "Ã¤ Ã¶")]
    d = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "'x' as garbled")
    out = repair_encoding(d).collect()
    got = {(r["id"], r["garbled"], r["lossy"]) for r in out}
    assert len(out) == 8 and got == {(1, False, False), (2, True, False), (3, False, False), (4, False, False), (5, True, True), (6, False, False), (None, True, False)}
    assert {r["text"] for r in out if r["id"] == 2} == {t}
    assert repair_encoding(d.limit(0)).count() == 0


def test_twins_teach_the_chain(spark):
    a, b = "Die Tür an der Größe schließt nicht mehr.", "Quelle drôle de pièce à côté, réglée après l’été."
    bad = [a.encode("cp1252").decode("mac_roman"), b.encode("cp1252").decode("cp1251")]
    d = spark.createDataFrame(list(enumerate([a, b, *bad])), "id long, text string")
    learned = learn_chains(d)
    assert ("mac_roman", "cp1252") in learned and ("cp1251", "cp1252") in learned
    out = {r["id"]: r["text"] for r in repair_encoding(d).collect()}
    assert out[2] == a and out[3] == b


def test_lost_characters_from_twins(spark):
    d = spark.createDataFrame([(1, "Wir können die Straße sehen."), (2, "Wir k�nnen die Stra�e sehen."), (3, "Kein Zwilling f�r mich.")], "id long, text string")
    assert [(r["id"], r["text"]) for r in restore_lost(d).collect()] == [(2, "Wir können die Straße sehen.")]


def test_repaired_query_restores_what_twins_give(spark, tmp_path):
    from vellumine.llm.queries import p4_repaired

    rows = [(1, "Wir können die Straße sehen."), (2, "Wir k�nnen die Stra�e sehen. Kein Zwilling f�r mich."), (3, "Wir k�nnen die Stra�e sehen."), (3, "Wir k�nnen die Stra�e sehen."), (4, None), (5, "Wir kännen die Stra�e sehen."), (None, "Wir k�nnen die Stra�e sehen.")]
    spark.createDataFrame(rows, "id long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = sorted(((r["id"] or 0, r["garbled"], r["lossy"], r["text"]) for r in p4_repaired(spark, str(tmp_path)).collect()), key=str)
    whole = "Wir können die Straße sehen."
    assert got == [(0, True, False, whole), (1, False, False, whole), (2, True, True, f"{whole} Kein Zwilling f�r mich."), (3, True, False, whole), (3, True, False, whole), (4, False, False, None), (5, True, True, rows[5][1])]


def test_characters_are_aligned_between_ascii_anchors():
    clean = "Für die Straße: ж"
    for w, r in [("cp1252", "utf-8"), ("gbk", "utf-8")]:
        try:
            bad = clean.encode(r).decode(w)
        except UnicodeDecodeError:
            continue
        if len(bad) > len(clean):
            assert _aligned(bad, clean)[0] == ("Ã¼", "ü") and (w, r) in mappings_of(bad, clean)
    assert _aligned("a b", "a c") is None and mappings_of("Fär", "Für") == [x for x in mappings_of("Fär", "Für") if x not in SURE]
    assert mappings_of("gleich ü", "gleich ü") == []


def test_many_layers(spark):
    t = "Für die Gebühr ist die Straße zuständig."
    bad = [t]
    for _ in range(6):
        bad.append(bad[-1].encode().decode("latin-1"))
    d = spark.createDataFrame(list(enumerate(bad)), "id long, text string")
    assert {r["text"] for r in repair_encoding(d).collect()} == {t}


def test_nothing_is_applied_that_no_twin_taught(spark):
    d = spark.createDataFrame([(1, "Nur fÃ¼r mich, ohne Zwilling, fÃ¤llt ÃŸ auf."), (2, "plain")], "id long, text string")
    assert not any(r["garbled"] for r in repair_encoding(d).collect())
    assert [r["text"] for r in repair_encoding(d, chains=SURE).where("garbled").collect()] == ["Nur für mich, ohne Zwilling, fällt ß auf."]


def test_quick_tests_of_odd_places_agree_with_the_rules():
    import random

    from vellumine.llm.encoding import _ODD, _is_odd

    rng = random.Random(1)
    signs = list("abkmcZXé àÉÖÞ÷¿³¹·¼¸ŸŒı˜ßÿ«»°ﬁ‰ж1_ЖЯёЁіЂαΩ/%'’-.,\n\x85—")
    for _ in range(30_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 9)))
        assert _is_odd(text) == any(_ODD.search(line) for line in text.split("\n")), repr(text)


def test_twins_of_crowded_skeletons_teach(spark):
    crowd = [chr(0xAC00 + 7 * i) + chr(0xB000 + 5 * i) + "다" for i in range(120)]  # all of the empty skeleton, each with more rows than the twins
    rare = "안녕하세요"
    rows = [x for x in (*crowd, *(f"{x}\ufffd" for x in crowd)) for _ in range(2)] + [rare, rare.encode().decode("latin-1")]
    assert learn_chains(spark.createDataFrame([(x,) for x in rows], "text string")) == [("latin-1", "utf-8")]


def test_twins_are_those_of_all_pairs(spark):
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from vellumine.llm.encoding import ALL, _misread, _twins

    rng = random.Random(3)
    words = ["за", "квитанцию", "Größe", "für", "naïve", "—", "«да»", "電気の", "使用量", "缴清报告", "ж", "œuvre", "gęś", "№", "plain", "0", "ñ", "안녕"]
    segs = set()
    for _ in range(1000):
        clean = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        w, r = rng.choice(ALL)
        bad = [_misread(x, w, r) or x if rng.random() < 0.7 else x for x in clean]
        segs |= {" ".join(clean), " ".join(bad)}
    d = spark.createDataFrame([(x, not set(x.split()) <= set(words)) for x in sorted(segs)], "seg string, bad boolean")
    d = d.select(F.xxhash64("seg").alias("id"), F.xxhash64(F.regexp_replace("seg", r"[^\x00-\x7f]+", "_")).alias("mark"), "seg", "bad").cache()
    good, wrong = ([r["seg"] for r in d.where(d["bad"] == b).collect()] for b in (False, True))
    true = Counter((g, c) for g in wrong for c in good if mappings_of(g, c))
    got = Counter((r["g"], r["c"]) for r in _twins(d).collect() if mappings_of(r["g"], r["c"]))
    split = Counter((r["g"], r["c"]) for r in _twins(d, 0).collect() if mappings_of(r["g"], r["c"]))
    mixed = [(g, c) for g, c in true if set(g.split()) & set(c.split()) - {"plain", "0"}]
    assert len(true) > 200 and len(mixed) > 50 and got == true == split


def test_the_order_of_what_is_learned_does_not_choose_unlikely_readings():
    first = [("cp1252", "cp874"), ("cp1252", "cp1256"), ("cp1251", "cp866"), ("cp1251", "iso8859-5"), ("cp1252", "big5")]
    for text, w, r in [("La copropriété du 15 février a été réglée.", "mac_roman", "cp1252"), ("Wie hoch ist die Rechnung für 2026?", "cp1251", "cp1252"), ("| claim form | £400.73 |", "cp1251", "cp1252"), ("ช่างจะมาตรวจจดหมายพรุ่งนี้เช้า", "cp1252", "cp874")]:
        assert repair(text.encode(r).decode(w), [*first, ("mac_roman", "cp1252"), ("cp1251", "cp1252")]) == (text, True)
