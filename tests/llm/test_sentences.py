import numpy as np
import pytest

from probloom.llm import sentences as S

CASES = [
    ("One is here. Two is there.", ["One is here.", "Two is there."]),
    ("Dr. Smith came at 5 p.m. on Jan. 3. It was 3.14 m.", ["Dr. Smith came at 5 p.m. on Jan. 3.", "It was 3.14 m."]),
    ("He said: “Stop now. Go home.” Then he left.", ["He said: “Stop now. Go home.”", "Then he left."]),
    ("“Is it true?” asked Mary. (All rows were kept.) Yes!", ["“Is it true?” asked Mary.", "(All rows were kept.)", "Yes!"]),
    ("The value (approx. 3 on average) fell. [6] Next one.", ["The value (approx. 3 on average) fell. [6]", "Next one."]),
    ("これは本です。彼は「はい。そうです。」と言った。終わり！", ["これは本です。", "彼は「はい。そうです。」と言った。", "終わり！"]),
    ("「真的吗？」王先生问道。他说：“好。走吧。”我们走了。", ["「真的吗？」王先生问道。", "他说：“好。走吧。”", "我们走了。"]),
    ("यह सच है। वह गया। क्यों?", ["यह सच है।", "वह गया।", "क्यों?"]),
    ("Πού είναι; Εδώ είναι· ναι.", ["Πού είναι;", "Εδώ είναι· ναι."]),
    ("كم عدد الصفوف؟ هذا يكفي. لا تحذفوا!", ["كم عدد الصفوف؟", "هذا يكفي.", "لا تحذفوا!"]),
    ("ไม่มีใครอ่าน ค่า x0 เท่ากับ 3 ในตาราง ดูรูปที่ 5 และหัวข้อ", ["ไม่มีใครอ่าน", "ค่า x0 เท่ากับ 3 ในตาราง", "ดูรูปที่ 5 และหัวข้อ"]),
    ("Title line\n\nA sentence that\nruns on. Another.\n1) first item\n2) second item.\n", ["Title line", "A sentence that\nruns on.", "Another.", "1) first item", "2) second item."]),
    ("In May it had\n36. The lab is cold.", ["In May it had\n36.", "The lab is cold."]),
    ("Combien de lignes ? « Est-ce vrai\xa0? » demande Jean.", ["Combien de lignes ?", "« Est-ce vrai\xa0? » demande Jean."]),
    ("Wait... or not. Then... Nobody came.", ["Wait... or not.", "Then...", "Nobody came."]),
    ("    ", []), ("", []), (None, []), ("no end mark", ["no end mark"]), ("„Stimmt das?“, fragte er.\r\n\r\nJa.", ["„Stimmt das?“, fragte er.", "Ja."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_units_with_the_prior_weights(text, want):
    assert [text[a:b] for a, b in S.sentences(S.Model(), text)] == want


def test_units_are_disjoint_ordered_and_trimmed():
    text = ' "A. B" c. (D e. f! «g? h» ) „ “ ] [ x.\n\n 3. y\n * z  q? 」 「' * 20
    at = 0
    for a, b in S.sentences(S.Model(), text):
        assert at <= a < b and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert "".join(text[a:b] for a, b in S.sentences(S.Model(), text)).replace(" ", "").replace("\n", "").replace(" ", "") == "".join(text.split())


def test_hostile_texts_end_soon():
    import time

    for text in ("(" * 30000, "„" * 20000 + "“", ". " * 30000, "a" * 300000, "[1] " * 20000, "«»" * 20000):
        began = time.time()
        S.sentences(S.Model(), text)
        assert time.time() - began < 10


def test_training_learns_an_unlisted_abbreviation(spark):
    said = ("We saw it {w}. Nobody asked Zqx. Holm about it.", "Nobody asked Zqx. Holm about it. We saw it {w}.")
    rows = [(i, f"The sample of Zqx. Berg was {w}. It weighs zqx. {i} grams.\n\n" + said[i // 4 % 2].format(w=w), 1) for i, w in enumerate(["red", "blue", "green", "grey"] * 60)]
    docs = spark.createDataFrame([*rows, (900, None, 1), (901, "", 1)], "doc_id long, text string, n int")
    model = S.train(docs)
    text = rows[0][1]
    assert [text[a:b] for a, b in S.sentences(model, text)] == ["The sample of Zqx. Berg was red.", "It weighs zqx. 0 grams.", "We saw it red.", "Nobody asked Zqx. Holm about it."]
    units = S.sentence_units(docs, model)
    assert units.count() == 240 * 4 and units.where("doc_id >= 900").count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.sentence_units(docs, S.train(docs)).count() == 0


def test_marks_without_a_partner_never_matter_however_many():
    for n in (39, 41, 42, 410):
        text = "( " * n + "He said: «Stop now. Go home.» Then."
        assert [text[a:b] for a, b in S.sentences(S.Model(), text)][-1] == "Then." and len(S.sentences(S.Model(), text)) == 2
    assert S.spans("(a «b) c» d", 0, 11) == [(0, 5)] and S.spans("„a (“b” c) d“", 0, 13) == [(0, 12)] and S.spans("« a «b» c", 0, 9) == [(4, 6)]


def test_tokens_are_whole():
    word = "x" * 500
    assert S.before_token(f"a {word}.", 0, 502) == (word, word)
    assert S.before_token(f"{word} 12.", 0, 503) == ("12", f"{word} 9")
    assert S.after_token(f" {word} y", 0, 503) == ("x", word)


def test_counts_of_every_token_reach_the_model(spark):
    # 30,000 tokens, each seen twice: as many as any cap on the vocabulary would cut.
    texts = [(i, " ".join(f"w{chr(97 + i % 26)}{j}q. Next one." for j in range(i * 100, i * 100 + 100)).translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(300)]
    model = S.train(spark.createDataFrame(texts, "doc_id long, text string"))
    seen = [model._counts(model.before, S.before_token(f"w{chr(97 + i % 26)}{j}q.".translate(str.maketrans("0123456789", "abcdefghij")), 0, len(f"w{chr(97 + i % 26)}{j}q"))[1])[0] for i in range(300) for j in range(i * 100, i * 100 + 100)]
    assert min(seen) >= 1
    assert np.mean(np.array(seen) > 1) < 0.05  # cells shared by chance


def test_model_beats_chance_on_held_out_cases(spark):
    # Abbreviations unlisted and learned from counts alone.
    rng = np.random.default_rng(4)
    words = ["melt", "glass", "sample", "image", "oven", "patient"]
    def sentence():
        w = list(rng.choice(words, 5))
        if rng.random() < 0.5:
            w[2] = "zorb. " + str(rng.choice(["Lab", "Unit", "Room"]))
        return (" ".join(w)).capitalize().replace("zorb. lab", "zorb. Lab").replace("zorb. unit", "zorb. Unit").replace("zorb. room", "zorb. Room") + "."
    docs = [(i, "\n\n".join(" ".join(sentence() for _ in range(3)) for _ in range(4))) for i in range(300)]
    model = S.train(spark.createDataFrame(docs[:200], "doc_id long, text string"))
    right = sum(len(S.sentences(model, t)) == 12 for _, t in docs[200:])
    assert right >= 97
