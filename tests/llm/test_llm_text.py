import random

import pytest

from chronoloom.llm.sentences import Splitter, repaired, sentence_ends
from chronoloom.llm.tokens import decoded, encoder, token_counts, token_ids

MODEL = {
    "latin/en": {"abbreviation": {"dr", "capt", "etc"}, "starter": {"The", "He", "She", "We", "It", "Dr"}, "collocation": {"jr Smith"}},
    "latin/de": {"abbreviation": {"z", "nr"}, "starter": {"Der", "Das", "Wir"}},
    "han/": {"starter": {"船长", "邻居"}},
    "cyrillic/": {"starter": {"Никто", "Механик"}, "abbreviation": {"ул"}},
}


def cue(*texts, stop="\n"):
    lines = []
    for i, t in enumerate(texts, 1):
        lines += [str(i), f"00:00:0{i % 10},000 --> 00:00:0{i % 10},900", *t.split("\n"), ""]
    return stop.join(lines)


def said(text, lang="en"):
    return [text[:e].replace("\r", "").split("\n")[-1][-14:] for e in Splitter(MODEL).ends(text, lang)]


def check(text, lang, *ends):
    found = Splitter(MODEL).ends(text, lang)
    assert len(found) == len(ends), [text[:e][-20:] for e in found]
    for e, want in zip(found, ends):
        assert text[:e].endswith(want), (text[:e][-20:], want)


@pytest.mark.parametrize("stop", ["\n", "\r\n", "\r"])
def test_marks_abbreviations_and_numbers(stop):
    check(cue("He met Dr. Venn at 7.45 p.m. sharp. She left!! We saw", stop=stop), "en", "sharp.", "left!!", "saw")
    check(cue("They sell rope, etc. The end .", "Wait... don't touch it.", stop=stop), "en", "etc.", "end .", "it.")
    check(cue("Das war im 9. Jahrhundert. Der Bär…"), "de", "Jahrhundert.", "Bär…")


def test_sentences_over_lines_and_cues():
    check(cue("The captain lost the map\nbefore dawn.", "He went", "[door slams]", "home alone", "The end?"), "en", "dawn.", "alone", "end?")
    check(cue("He waited by the...", "...pump. It rained"), "en", "pump.", "rained")
    check(cue("船长忘了带", "钥匙。船长走了", "邻居来了？"), "zh", "钥匙。", "走了", "来了？")


def test_quotations_belong_to_their_sentence():
    check(cue('He shouted "Stop!" and jumped. "Where is it?" she asked.', '"Go."'), "en", "jumped.", "asked.", '"Go."')
    check(cue("“快！我们走吧。”老人喊道。船长走了。"), "zh", "喊道。", "走了。")


def test_opening_quotation_after_a_mark_and_dialogue_dashes():
    check(cue("这本《灯》我看过。“快！我们走吧。”老人喊道。"), "zh", "我看过。", "喊道。")
    check(cue("- He waited…\n- ls it late?", "«Где ключ?»\n— спросила она."), "en", "waited…", "late?", "она.")


def test_learning_tells_abbreviations_from_last_words(spark):
    from chronoloom.llm.sentences import learned

    rng = random.Random(5)
    names = ["Brask", "Venn", "Tarrow", "Halvik", "Morrow"]
    verbs = ["sleeps", "waits", "sings", "walks", "reads", "talks", "thinks"]
    say = lambda: rng.choice([f"The captain {rng.choice(verbs)} by night.", f"She {rng.choice(verbs)} here again.", f"Ask Capt. {rng.choice(names)} about {rng.choice(verbs)} now.", f"See fig. {rng.randrange(9)} for what {rng.choice(verbs)} below."])
    rows = [(i, cue(*[f"{say()} {say()}" for _ in range(6)]), "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = {(r.kind, r.item) for r in learned(df, "text", "lang").where("language = 'latin/en'").collect()}
    assert {("abbreviation", "capt"), ("abbreviation", "fig"), ("starter", "The"), ("starter", "She")} <= found
    assert not {("abbreviation", w) for w in ("night", "again", "now", "below")} & found and ("starter", "Brask") not in found


def test_learning_follows_one_rule_at_every_size(spark):
    from chronoloom.llm.sentences import learned

    small = spark.createDataFrame([(i, cue("Ask nr. Orla now.", "Ask nr. Venn now."), "en") for i in range(3)], "doc_id long, text string, lang string")
    large = spark.sql("SELECT 9L AS doc_id, repeat('ok.\\nno\\n', 1500000) AS text, 'en' AS lang")  # 1.5 million periods
    split = lambda df: {(r.doc_id, r.end_char) for r in sentence_ends(df, "doc_id", "text", "lang").collect()}
    assert len(split(small)) == 6 and split(small) == split(small.unionByName(large))
    lines = "concat_ws('\\n', transform(sequence(0, 2999), i -> concat('w', id * 500 + i div 6, 'k. Z', id * 500 + i div 6, 'h')))"
    many = spark.range(0, 401, numPartitions=4).selectExpr(f"{lines} AS text", "'en' AS lang")  # each of 200,500 pairs six times
    assert learned(many, "text", "lang").where("language = 'latin/en' and kind = 'collocation'").count() == 200_500


def test_bare_forms_count_by_their_share_at_every_size(spark):
    rows = [(i, cue("Ask st. 21 now.", "Ask st. 7 now.") if i < 10 else cue("Ask st now."), "en") for i in range(12)]
    for copies in (1, 20):
        df = spark.createDataFrame(rows * copies, "doc_id long, text string, lang string").coalesce(1)
        assert sentence_ends(df, "doc_id", "text", "lang").count() == 22 * copies, copies


def test_what_nobody_says():
    text = cue("[SIGHS]", "♪ la la ♪", "OLD MAN: The <i>boat.</i> (coughing)", "- He ran\n- We hid.", "*glass breaks*", "Subtitles by Team X - www.x.example")
    check(text, "en", "boat.", "ran", "hid.", "www.x.example")


def test_scripts_without_marks_and_cases():
    check(cue("กัปตันขายเรือ พวกเรารอ\nมี 207 คนอยู่บนเรือ"), "th", "ขายเรือ", "พวกเรารอ", "บนเรือ")
    check(cue("Πού είναι το κλειδί; Κοστίζει."), "el", "κλειδί;", "Κοστίζει.")


def test_wrong_encodings():
    plain = cue("Никто не видел моста… Механик забыл ключ.", "船长忘了。邻居来了。")
    broken = plain.encode().decode("latin-1")
    fixed, places = repaired(broken, "ru")
    assert fixed == plain and places[-1] == len(broken)
    assert [broken[:e].encode("latin-1").decode()[-2:] for e in Splitter(MODEL).ends(broken, "ru")] == ["а…", "ч.", "了。", "了。"]
    koi = cue("Никто не видел моста. Механик забыл ключ.").encode("koi8-r").decode("latin-1")
    assert [koi[e - 1] for e in Splitter(MODEL).ends(koi, "ru")] == [".", "."]
    assert repaired("é à ok") == ("é à ok", None)


def test_no_cues_no_sentences_and_odd_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abdegiklmnoprstu") for _ in range(7))
    long = cue(*[f"The {word()} {word()}. The {word()}." for _ in range(3000)])
    rows = [(1, None, "en"), (2, "", None), (3, "No cue here.", "en"), (4, cue("The end."), None), (4, cue("The end."), None), (None, cue("A b?"), "xx"), (7, long, "en"), (8, "1\n00:00:01,000 --> 00:00:02,000", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as end_char")
    got = {}
    for r in sentence_ends(df, "doc_id", "text", "lang").collect():
        got.setdefault(r.doc_id, []).append(r.end_char)
    assert set(got) == {4, None, 7} and len(got[4]) == 2 and len(got[7]) == 6000
    assert sentence_ends(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_pieces_encode_as_the_whole_and_decode():
    own, rng = encoder(), random.Random(3)
    alphabet = " \n\t\r\xa0　\x1c 'sdL12.,:é中ก²!\x85​<|endoftext|>"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert own.encode(text) == own._encode(text) and own.count(text) == len(own.encode(text))
        assert own.decode(own.encode(text)) == text.encode()
    for _ in range(300):
        text = "".join(rng.choice("กขัา中文。é1'st!´") for _ in range(rng.randrange(200, 600)))
        assert own.encode(text) == own._encode(text)
    long = "a" * 200_000 + " 00:01:02,345 " + "ก" * 5_000
    assert own.encode(long) == own._encode(long)


def test_token_operators(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "<|endoftext|> hi", ""), (3, "<|endoftext|> hi", ""), (None, "x", "")], "doc_id long, text string, ids string")
    rows = token_ids(df, "doc_id", "text").collect()
    assert sorted(((r.doc_id or 0), list(r.ids)) for r in rows) == sorted([(1, []), (2, []), (3, encoder().encode("<|endoftext|> hi")), (3, encoder().encode("<|endoftext|> hi")), (0, encoder().encode("x"))])
    assert 50256 not in rows[2].ids
    assert sorted(r.tokens for r in token_counts(df, "doc_id", "text").collect()) == sorted(len(r.ids) for r in rows)
    assert {bytes(r.ids) for r in decoded(token_ids(df, "doc_id", "text"), "ids").collect()} == {b"", b"<|endoftext|> hi", b"x"}
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0
