"""Precision and recall of sentence ends on planted cases in twelve languages, learned from nothing but these texts."""

import random

from chronoloom.llm.sentences import sentence_ends

# people, what they do, an abbreviation with what follows it, and the closing marks of each language
LANGUAGES = {
    "en": (["The captain", "She", "Our neighbour", "We"], ["lost the old map", "waits by the well", "painted that door", "sold two boats"], ["with Capt. Venn", "as fig. 3 shows", "near St. Orla"], ".!?"),
    "fr": (["Le capitaine", "Elle", "Notre voisin", "Nous"], ["a perdu la carte", "attend près du puits", "peint cette porte", "vend deux bateaux"], ["avec Mme. Venn", "comme la fig. 3", "chez Mgr. Orla"], ".!?"),
    "de": (["Der Kapitän", "Sie", "Unser Nachbar", "Wir"], ["verlor die Karte", "wartet am Brunnen", "strich diese Tür", "kauft zwei Boote"], ["mit Hr. Venn", "wie Abb. 3 zeigt", "bei Nr. 7 drüben"], ".!?"),
    "es": (["El capitán", "Ella", "Nuestro vecino", "Nosotros"], ["perdió el mapa", "espera junto al pozo", "pintó esa puerta", "vende dos barcos"], ["con Sra. Venn", "como la fig. 3", "junto a Dña. Orla"], ".!?"),
    "it": (["Il capitano", "Lei", "Il vicino", "Noi"], ["perse la mappa", "aspetta al pozzo", "dipinse la porta", "vende due barche"], ["con Sig. Venn", "come la fig. 3", "da Dott. Orla"], ".!?"),
    "ru": (["Капитан", "Она", "Наш сосед", "Мы"], ["потерял карту", "ждёт у колодца", "покрасил эту дверь", "продаёт две лодки"], ["на ул. Садовой", "как рис. 3 учит", "у гр. Орловой"], ".!?"),
    "el": (["Ο καπετάνιος", "Εκείνη", "Ο γείτονας", "Εμείς"], ["έχασε τον χάρτη", "περιμένει εκεί", "έβαψε την πόρτα", "πουλά δύο βάρκες"], ["με κ. Βενή", "δες σελ. 3 εδώ", "στην οδ. Όρλα"], ".!;"),
    "ar": (["القبطان", "جارتنا", "الرجل", "نحن"], ["فقد الخريطة القديمة", "ينتظر عند البئر", "دهن ذلك الباب", "باع قاربين"], ["في الصباح الباكر", "قبل العاصفة", "مع الفجر"], ".!؟"),
    "hi": (["कप्तान", "वह", "पड़ोसी", "हम"], ["नक्शा भूल गया", "कुएँ पर खड़ा है", "दरवाज़ा रंगता है", "नाव बेचता है"], ["सुबह के समय", "तूफान से पहले", "रात के बाद"], "।!?"),
    "zh": (["船长", "邻居", "我们", "老人"], ["弄丢了地图", "在井边等着", "把门漆成绿色", "卖掉了两条船"], ["在天亮之前", "因为暴风雨", "已经第三次了"], "。！？"),
    "ja": (["船長は", "隣人は", "私たちは", "老人は"], ["地図をなくした", "井戸で待っている", "扉を塗った", "船を売った"], ["夜明け前に", "嵐のために", "三度目に"], "。！？"),
    "ko": (["선장은", "이웃은", "우리는", "노인은"], ["지도를 잃었다", "우물에서 기다린다", "문을 칠했다", "배를 팔았다"], ["해 뜨기 전에", "폭풍 때문에", "세 번째로"], ".!?"),
}
ADVERTS = ["Get it all at http://subs.quill.example/dl?id=4.7", "Made better by old.moss for reel.example"]


def said(rng, language):
    people, deeds, asides, marks = LANGUAGES[language]
    space = "" if language in ("zh", "ja") else " "
    words = [rng.choice(people), rng.choice(asides) if rng.random() < 0.4 and language not in ("en", "fr", "de", "es", "it", "ru", "el") else rng.choice(deeds)]
    if language in ("zh", "ja", "ko", "ar", "hi"):
        words.append(rng.choice(deeds))
    elif rng.random() < 0.4:
        words.append(rng.choice(asides))
        words.append({"en": "again", "fr": "encore", "de": "wieder", "es": "otra vez", "it": "ancora", "ru": "снова", "el": "ξανά"}[language])
    if language == "en" and rng.random() < 0.1:
        return "Use www.tarrow.example, not the other one" + rng.choice(marks[:2])
    return space.join(words) + rng.choice(marks)


def document(rng, language):
    """A text and the places where its sentences end."""
    text, ends, cue = "", [], 0

    def open_cue():
        nonlocal text, cue
        cue += 1
        text += f"{cue}\n00:{cue // 60:02}:{cue % 60:02},000 --> 00:{cue // 60:02}:{cue % 60:02},900\n"

    for _ in range(14):
        kind = rng.random()
        open_cue()
        if kind < 0.08:
            text += rng.choice(["[SIGHS]", "♪ la la ♪", "(door slams)"]) + "\n\n"
        elif kind < 0.16:
            text += rng.choice(ADVERTS)
            ends.append(len(text))
            text += "\n\n"
        else:
            for n in range(rng.choice([1, 1, 2])):
                sentence = said(rng, language)
                cut = sentence.find(" ", len(sentence) // 2)
                text += (" " if n and language not in ("zh", "ja") else "")
                if rng.random() < 0.2 and cut > 0 and "." not in sentence[:-1] and sentence[cut + 1].islower():
                    text += sentence[:cut] + "\n\n"  # the sentence runs over two cues
                    open_cue()
                    text += sentence[cut + 1 :]
                else:
                    text += sentence
                ends.append(len(text))
            text += "\n\n"
    return text, ends


def test_recall_and_precision_in_every_language(spark):
    rng = random.Random(4)
    rows, true = [], {}
    for i in range(600):
        language = list(LANGUAGES)[i % len(LANGUAGES)]
        text, ends = document(rng, language)
        rows.append((i, text, rng.choice([language, language, language.upper(), None])))
        true[i] = (language, set(ends))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {}
    for r in sentence_ends(df, "doc_id", "text", "lang").collect():
        found.setdefault(r.doc_id, set()).add(r.end_char)
    for language in LANGUAGES:
        docs = [i for i, (own, _) in true.items() if own == language]
        both = sum(len(found[i] & true[i][1]) for i in docs)
        recall, precision = both / sum(len(true[i][1]) for i in docs), both / sum(len(found[i]) for i in docs)
        wrong = [rows[i][1][max(0, e - 30) : e + 10] for i in docs for e in sorted(found[i] ^ true[i][1])][:3]
        assert recall >= 0.99 and precision >= 0.99, (language, recall, precision, wrong)
