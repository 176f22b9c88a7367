"""Problems 1 and 2."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliomine.llm import broken_pairs as B
from foliomine.llm import disclosure as D

WORDS = [(w, "en") for w in "ear nose throat drum canal surgery packing bleeding hearing voice fold wound nerve sinus reflux".split()] + [(w, "de") for w in "gehör nase operation blutung untersuchung schleimhaut behandlung eingriff".split()]
EN = ["The ear canal is packed for three days after surgery.", "Bleeding from the nose is controlled by packing.", "Hearing improved after the operation in most patients.", "The nerve runs below the drum and is spared.", "Reflux is a frequent companion of a weak voice.", "The wound is closed and the drain is removed on the second day."]
DE = ["Die Schleimhaut ist dünn und wird während der Operation geschont.", "Vor der Behandlung sollte das Gehör gemessen werden.", "Nach dem Eingriff ist die Blutung oft gering."]


def logs():
    rng = random.Random(3)
    asked = ["What is the treatment of a wound of the ear?", "When is surgery of the nose indicated?", "How long is the nose packed?"]
    out = [(rng.choice(asked), None, " ".join(rng.sample(EN, 3))) for _ in range(160)]
    out += [("Wann sollte die Nase operiert werden?", None, " ".join(rng.sample(DE, 2))) for _ in range(60)]
    out += [(asked[0], None, "No."), (asked[1], None, "Usually packing")] * 5
    return out


@pytest.fixture(scope="module")
def fitted():
    return B.teach(logs(), WORDS)


def test_each_defect(fitted):
    q = "When is surgery of the nose indicated?"
    whole = " ".join(EN[:3])
    cases = {
        None: [whole, "No.", whole + " [book, p.7]", f"{q}\n\n{whole}", "The books do not give one figure, but this much is stated. " + whole],
        "empty": [None, "", " \n", "N/A", "...", "none", "[]", "\xa0"],
        "copied_question": [q, q.upper(), f"Q: {q}\nA: {q}", f'"{q[:-1]}"', f"You asked: {q}"],
        "refusal": ["I'm sorry, but I cannot answer this question.", "Unfortunately, nothing in the books covers this. Try rephrasing the question."],
        "wrong_language": [" ".join(DE[:2])],
        "truncated": [whole + " Bleeding from the", whole + " The nerve runs below the drum and (", whole[:-1] + ". Hearing improved after the oper", whole + " [book, p.7"],
    }
    for defect, answers in cases.items():
        for answer in answers:
            assert B.defect(q, None, answer, *fitted)[0] == defect, (defect, answer)


def test_a_language_that_is_asked_for(fitted):
    german = " ".join(DE[:2])
    assert B.defect("When is surgery of the nose indicated? Please answer in German.", None, german, *fitted)[0] is None
    assert B.defect(None, None, german, *fitted)[0] is None


def test_held_out_accuracy():
    rng = random.Random(11)
    sample = logs()
    rng.shuffle(sample)
    fitted = B.teach(sample[:160], WORDS)
    right = total = 0
    for question, _, answer in sample[160:]:
        words = answer.split()
        if len(words) < 12:
            continue
        cut = " ".join(words[: len(words) // 2 + 2])
        for text, defect in ((answer, None), (question, "copied_question")) + (((cut, "truncated"),) if cut[-1] not in ".!?" else ()):
            total += 1
            right += B.defect(question, None, text, *fitted)[0] == defect
    assert right >= 0.95 * total


REFUSED = ["I could not find this in the archive.", "We do not answer that kind of question.", "That is not covered by the chapters we hold.", "I'm sorry, but no source was found.", "Unfortunately I do not know."]


def test_refusals_held_out_by_phrase():
    """Phrases that stand neither in the lists nor among the logs the field is taught with."""
    rng = random.Random(5)
    taught = logs() + [(f"{q} {i}?", None, f"{a} {b}") for i, (q, a, b) in enumerate([(rng.choice("abc"), rng.choice(REFUSED), rng.choice(["Please read another chapter.", "Write to the desk."])) for _ in range(60)])]
    for held_out in REFUSED:
        fitted = B.teach([x for x in taught if held_out not in x[2]], WORDS)
        for after in ("", " Please read another chapter."):
            assert B.defect("How long is the nose packed?", None, held_out + after, *fitted)[0] == "refusal", held_out
        assert B.defect("How long is the nose packed?", None, " ".join(EN[:3]), *fitted)[0] is None


def test_languages_held_out_by_sentence(fitted):
    unseen = ["Der Gehörgang wird vor der Untersuchung gereinigt.", "Eine Blutung aus der Nase ist oft die Folge einer Entzündung."]
    for said in unseen:
        assert B.defect("When is surgery of the nose indicated?", None, said, *fitted)[0] == "wrong_language"
        assert B.defect("Wann sollte die Nase operiert werden?", None, said, *fitted)[0] is None
    assert B.defect("Wann sollte die Nase operiert werden?", None, " ".join(EN[:2]), *fitted)[0] == "wrong_language"


def test_corpus_refusals_leave_answers_out():
    taught = [(f"Why {i}?", None, f"We cannot answer this, sorry. {a}") for i, a in enumerate(["Write to the desk."] * 5 + [EN[0]] * 5)] + [(f"How {i}?", None, EN[0]) for i in range(9)]
    assert {c[2] for c in B.corpus_refusals(taught)} == {"We cannot answer this, sorry. Write to the desk."}


def test_no_phrase_comes_from_the_logs(spark):
    import os

    folder = "/root/testdata/sf0.01/query_logs.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    said = "\n".join(r[0].lower() for r in spark.read.parquet(folder).select("answer").where("answer is not null").collect())
    phrases = [x for o, b, a in B.PHRASES.values() for x in (b + "|" + a).split("|")] + list(B.MODEST)
    assert [x for x in phrases if x.lower() in said] == []


def test_pairs_on_frames(spark):
    rows = [(i, q, r, a, "x") for i, (q, r, a) in enumerate(logs())] + [(900, None, None, None, None), (901, "", "", "word " * 30_000, None), (901, "", "", "word " * 30_000, None)]
    df = spark.createDataFrame(rows, "id long, question string, resolved_question string, answer string, defect string")
    got = {r["log_id"]: r["defect"] for r in B.defects(df, WORDS).collect()}
    assert len(got) == len(rows) - 1 and got[900] == "empty" and got[901] != "empty"
    assert B.defects(df.where("id < 0"), WORDS).count() == 0


def kinds(text, terms=frozenset({"vika", "zedomtov", "mara", "tolin"}), contexts=frozenset()):
    return [(k, text[a:b]) for a, b, k in D.Finder(set(terms), set(contexts), {"the", "patient", "is"}).items(text)]


@pytest.mark.parametrize(
    "text, items",
    [
        ("Dr. Vika Zedomtov asked", [("name", "Vika Zedomtov")]),
        ("letter for vika zedomtov came", [("name", "vika zedomtov")]),
        ("Thanks, Mara", [("name", "Mara")]),
        ("My patient V. Zedomtov, NHS no. 999 708 4697, was seen", [("name", "V. Zedomtov"), ("id_number", "999 708 4697")]),
        ("Zedomtov, Vika, passport Z5944060", [("name", "Zedomtov, Vika"), ("id_number", "Z5944060")]),
        ("with Zedomtov and Tolin today", [("name", "Zedomtov"), ("name", "Tolin")]),
        ("Mara Unheard-Name called +44 7700 900 575", [("name", "Mara Unheard-Name"), ("phone", "+44 7700 900 575")]),
        ("reply to vika.zedomtov (at) mail.test.", [("email", "vika.zedomtov (at) mail.test")]),
        ("reply to a [at] ent [dot] clinic [dot] example", [("email", "a [at] ent [dot] clinic [dot] example")]),
        ("at Flat 23, 52 Zedomtov Road, Larkebrin QQ8 7ZZ tomorrow", [("address", "Flat 23, 52 Zedomtov Road, Larkebrin QQ8 7ZZ")]),
        ("P.O. Box 80, Oskford\nHow is it", [("address", "P.O. Box 80, Oskford")]),
        ("wohnhaft Larkgategasse 4, 00774 Halford, fragt", [("address", "Larkgategasse 4, 00774 Halford")]),
        ("Calle Larkbury 96, 5º B, Oskford. Qué", [("address", "Calle Larkbury 96, 5º B, Oskford")]),
        ("108 impasse des Millsides, 00971 Wendemouth, demande", [("address", "108 impasse des Millsides, 00971 Wendemouth")]),
        ("tel (030) 23125-286 or 212.555.0102 or 555-0157", [("phone", "(030) 23125-286"), ("phone", "212.555.0102"), ("phone", "555-0157")]),
        ("SSN 969-17-4551, MRN: 00670700", [("id_number", "969-17-4551"), ("id_number", "00670700")]),
        ("After a Zedomtov manoeuvre, Vika-Tolin sign positive", []),
        ("Lot 8560-422-938, Trial NK-4119-519, pages 431-435, 2019-2021, 185 000 platelets, Sats 88-92", []),
        ("12 North Wing beds, cost 40, T1bN2, 5 mg", []),
    ],
)
def test_items(text, items):
    assert kinds(text) == items


def pii_logs(spark):
    rows = [(i, f"Vika Tolin{c} {i % 7}", "Mara Tolin" if i % 2 else "Vika Zedomtov", f"The {w} is fine.") for i, (c, w) in enumerate(zip("?! " * 10, ["ear", "nose"] * 15, strict=False))]
    rows += [(200 + i, f"Seen with Dr {n} today", "Vika Tolin", "x") for i, n in enumerate(["Vika", "Tolin", "Mara", "Vika", "Tolin", "Mara", "Unheard"])]
    rows += [(100, None, None, None), (101, "", None, ""), (102, "word " * 30_000 + "Mara", None, None), (103, "Dear Mara, ok", None, "x"), (103, "Dear Mara, ok", None, "x")]
    return spark.createDataFrame(rows, "id long, question string, user_name string, answer string").withColumn("resolved_question", F.col("question")).withColumn("text", F.lit("clash")).withColumn("terms", F.lit(1))


def test_frames_and_both_ways_of_sending_terms(spark):
    df = pii_logs(spark)
    sent = {tuple(r) for r in D.items_found(df, ["ear", "nose", "dear", "word"]).collect()}
    joined = {tuple(r) for r in D.items_found(df, ["ear", "nose", "dear", "word"], sent=0).collect()}
    assert sent == joined
    assert (206, "question", "name", 14) in sent
    assert (103, "question", "name", 6) in sent and (102, "resolved_question", "name", 150_001) in sent
    clean = {(r["row_id"], r["field_name"]): r["text"] for r in D.sanitised(df, ["ear", "dear", "word"]).collect()}
    assert clean[103, "question"] == "Dear [NAME], ok" and clean[101, "question"] == "" and (100, "question") not in clean
    assert D.items_found(df.where("id < 0"), ["ear"]).count() == 0


def test_forms_that_are_common_in_answers_reveal_no_one(spark):
    rows = [(i, f"Order 0{i % 9}4 555 {1000 + i} please" if i % 2 else "ring 07700 900123 now", None, "x", f"The order number is 0{i % 9}4 555 {1000 + i}.") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, question string, resolved_question string, user_name string, answer string")
    assert D.harmless_forms(df, ("question", "resolved_question")) == {"phone:3 3 4"}
    found = {(r["pii_type"], r["start_pos"]) for r in D.items_found(df, ["order", "please", "ring", "now"]).collect()}
    assert found == {("phone", 6)}
    silent = df.withColumn("answer", F.lit("nothing"))
    assert {r["start_pos"] for r in D.items_found(silent, ["order", "please", "ring", "now"]).collect()} == {6, 7}
    copied = df.withColumn("answer", F.col("question"))
    assert D.harmless_forms(copied, ("question", "resolved_question")) == set()


def test_the_field_is_fitted_on_six_thousand_logs(spark):
    df = spark.range(7_000).select("id", *[F.lit("x").alias(c) for c in ("question", "resolved_question", "answer")])
    assert len(B.sample(df)) == 6_000 and B.EPOCHS == 6


def many_logs():
    """Logs with refusals, repeated closings without a full stop, and eight in words that nothing else holds."""
    rare = [(f"Wann ist der Brumsel {i} mit der Knolfe nicht gut?", None, "Der Brumsel wird von der Knolfe und dem Trapis im Gelmund und dem Sorbat geschont.") for i in range(8)]
    refused = [(f"Why {i}?", None, f"We cannot answer this, sorry. {a}") for i, a in enumerate(["Write to the desk."] * 9 + [EN[0]] * 5)]
    closed = [(f"How is ear number {i} packed?", None, f"{EN[i % 6]} See page {i}") for i in range(7)]
    return [(q, r, a) for q, r, a in logs() * 2 + rare + refused + closed + [(None, None, "x"), ("What?", None, None), ("What now?", "What?", "What now?")]]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id long, question string, resolved_question string, answer string")


def test_what_is_counted_is_counted_over_all_logs(spark):
    rows = many_logs()
    make, closing, around = B.known(frame_of(spark, rows).repartition(5), WORDS)
    listed, _ = B.teach(rows, WORDS)
    texts = [x for q, _, a in rows for x in (q, a) if x]
    words = sorted({w for t in texts for w in B._WORD.findall(t.lower())}) + ["unheard"]
    assert [make.languages.word(w) for w in words] == [listed.languages.word(w) for w in words]
    assert make.languages.word("knolfe") == {"de": 1.0}
    assert [make.ends.known(w) for w in words if not w.isdigit()] == [listed.ends.known(w) for w in words if not w.isdigit()]
    said = [" ".join(t.split()[:n]) for t in sorted(set(texts)) for n in range(1, 12)]

    def side(p):
        return [p < 0.05, p < 0.25, p > 0.3, p < 0.5]

    assert [side(make.ends.likely(c)) for c in said] == [side(listed.ends.likely(c)) for c in said]
    frames = {f for q, r, a in rows if q and a for f in B._framed(q, r, B.clauses(a))[0]}
    assert {f for f in frames if f in around} >= {"write to the desk"} and "write to the desk" in B._surrounding(B._pairs(rows))
    assert "see page #" in closing and "usually packing" not in closing


def test_an_ending_of_few_logs_is_learnt_from_all(spark):
    """Fourteen logs of two thousand end in the same words without a full stop; a part of the logs has too few of them."""
    ending = [(f"How is ear number {i} packed?", None, f"{EN[i % 6]} Compare the lower plate") for i in range(14)]
    rows = [*ending, *logs() * 8]
    got = {r["log_id"]: r["defect"] for r in B.defects(frame_of(spark, rows), WORDS, 400).collect()}
    assert [got[i] for i in range(14)] == [None] * 14


def test_every_log_is_in_a_shard_however_the_table_lies(spark):
    df = frame_of(spark, many_logs())
    field = B.taught(df.repartition(1), WORDS, 60)[1]
    assert B.taught(df.repartition(7), WORDS, 60)[1].weights.tolist() == field.weights.tolist()
    held = list(B.shards(iter([{"question": [str(i) for i in range(n, n + 65)], "resolved_question": [None] * 65, "answer": ["a"] * 65} for n in (0, 65, 130)]), 60))
    assert [len(x) for x in held] == [60, 60, 75] and [q for part in held for q, _, _ in part] == [str(i) for i in range(195)]
    long = [{"question": ["q"] * 3, "resolved_question": [None] * 3, "answer": ["a" * B.SHARD_CHARS] * 3}]
    assert [len(x) for x in B.shards(iter(long), 60)] == [1, 1, 1]
