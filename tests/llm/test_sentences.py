import pytest

from vellumine.llm.sentences import sentence_units

CASES = {
    "abbreviations": ("Dr. Hill paid approx. £6,301 incl. VAT at 2.4%. Mr. R. V. Tam left at 9.00 p.m. Mrs. Lee came.", ["Dr. Hill paid approx. £6,301 incl. VAT at 2.4%.", "Mr. R. V. Tam left at 9.00 p.m.", "Mrs. Lee came."]),
    "quotation": ('"We saw it. Nobody told us," Lee wrote. “Keep it,” said Ms. Po, “it is old.” I left.', ['"We saw it. Nobody told us," Lee wrote.', "“Keep it,” said Ms. Po, “it is old.”", "I left."]),
    "brackets": ("(The test was moved in 2023.) They stayed.", ["(The test was moved in 2023.)", "They stayed."]),
    "lower start": ("All fine. iMeter units were sold, e.g. one. Well ... it is.", ["All fine.", "iMeter units were sold, e.g. one.", "Well ... it is."]),
    "ordinals": ("Die Heizung vom 17. März 2025 wurde geprüft. Bis zum 7. Juni zahlen. Es waren 7. Marie kam, z. B. Eskish, u. a. heute.", ["Die Heizung vom 17. März 2025 wurde geprüft.", "Bis zum 7. Juni zahlen.", "Es waren 7.", "Marie kam, z. B. Eskish, u. a. heute."]),
    "glued": ("Квартира готова.Мастер сказал, т. е. ушёл.", ["Квартира готова.", "Мастер сказал, т. е. ушёл."]),
    "french": ("Quelle facture ! « La pièce est là. Merci », a dit Mme Po. Le Dr Lee vient.", ["Quelle facture !", "« La pièce est là. Merci », a dit Mme Po.", "Le Dr Lee vient."]),
    "chinese": ("请在3天内缴清！“合同丢了。请等等。”管理员这样回复。数字为8.4元。", ["请在3天内缴清！", "“合同丢了。请等等。”管理员这样回复。", "数字为8.4元。"]),
    "japanese": ("え、ない?「要りません。もう払いました。」と言った。", ["え、ない?", "「要りません。もう払いました。」と言った。"]),
    "greek": ("Πότε θα έρθει η αίτηση; Μην ξεχάσετε! Ο κ. Λι ήρθε.", ["Πότε θα έρθει η αίτηση;", "Μην ξεχάσετε!", "Ο κ. Λι ήρθε."]),
    "hindi": ("डॉ. शर्वेल ने देखा। आज ही भेजिए!", ["डॉ. शर्वेल ने देखा।", "आज ही भेजिए!"]),
    "thai": ("กรุณาชำระเงิน 832 บาทก่อนสิ้นเดือน ช่างจะมาตรวจ\nยังไม่พบ", ["กรุณาชำระเงิน 832 บาทก่อนสิ้นเดือน", "ช่างจะมาตรวจ", "ยังไม่พบ"]),
    "arabic": ("قال د. مرواد إن الفاتورة ضاعت. هل دفعتم؟ نعم.", ["قال د. مرواد إن الفاتورة ضاعت.", "هل دفعتم؟", "نعم."]),
    "structure": ("# Costs\n\nIt could\nnot be. Fine\n\n- old key\n- A sentence. Another.\n\n| a | b. c |\n|---|---|\n| 1 | 2 |\n\n> Quoted line.", ["Costs", "It could\nnot be.", "Fine", "old key", "A sentence.", "Another.", "| a | b. c |", "| 1 | 2 |", "Quoted line."]),
    "crlf": ("One.\r\n\r\nTwo has\r\nmore. End.", ["One.", "Two has\r\nmore.", "End."]),
    "url": ("See www.a.example/form.v2.html?x=1 now. Done?! Yes.", ["See www.a.example/form.v2.html?x=1 now.", "Done?!", "Yes."]),
}


@pytest.fixture(scope="module")
def units(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES.values())]
    out = sentence_units(spark.createDataFrame(rows, "doc_id long, text string, unit string")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start_char"])):
        assert rows[r["doc_id"]][1][r["start_char"] : r["end_char"]] == r["unit"]
        got.setdefault(r["doc_id"], []).append(r["unit"])
    return got


@pytest.mark.parametrize("name", CASES)
def test_units(units, name):
    i = list(CASES).index(name)
    assert units[i] == CASES[name][1]


def test_odd_rows(spark):
    long = "A short one. " * 3000
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "Yes. No."), (4, "Twice."), (4, "Twice."), (5, long), (6, "a \ue000b. C")]
    out = sentence_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = {}
    for r in out:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n == {None: 2, 4: 2, 5: 3000, 6: 2}
    assert sentence_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_brackets_within_brackets(spark):
    cases = [
        ('He left ("too late. Really!"). They stayed.', ['He left ("too late. Really!").', "They stayed."]),
        ("(Kept “as it was.” Then lost.) Gone. Why?", ["(Kept “as it was.” Then lost.)", "Gone.", "Why?"]),
        ("(It was found.)” He said. No.", ["(It was found.)”", "He said.", "No."]),
        ("An open ( bracket. Next one.", ["An open ( bracket.", "Next one."]),
    ]
    out = sentence_units(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    for i, (_, want) in enumerate(cases):
        assert [r["unit"] for r in sorted(out, key=lambda r: r["start_char"]) if r["doc_id"] == i] == want


def test_one_paragraph_of_many_sentences(spark):
    import time

    took = []
    for n in (4_000, 32_000):
        d = spark.createDataFrame([(1, "A short sentence (with 3.5 words. Or more.) stands here. " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert sentence_units(d).count() == n
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * max(took[0], 0.5)  # eight times the text; a quadratic plan takes 64 times as long
