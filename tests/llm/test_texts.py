import random

import pytest

from quillvec.llm.quality import Profiler, known_words, text_quality
from quillvec.llm.reading import reading_levels

PROSE = [
    "The old man walked down to the harbour and waited for the boat that would bring his daughter home before the winter.",
    "THE STORM BROKE OVER THE VALLEY WHILE THEY WERE STILL LOOKING FOR THE CHILDREN, AND NOBODY KNEW WHERE TO TURN.",
    "Der alte Mann ging zum Hafen und wartete auf das Schiff, das seine Tochter vor dem Winter nach Hause bringen sollte.",
    "El viejo bajó al puerto y esperó el barco que debía traer a su hija a casa antes de que llegara el invierno.",
    "Le vieil homme descendit au port et attendit le bateau qui devait ramener sa fille à la maison avant la fin de l'hiver.",
    "He said <i>nothing</i> to the others &amp; went back to the house &mdash; it was empty, and the door stood open in the rain",
]
JUNK = [
    "apples; pears; plums; green melons; cherries; dates; figs; ripe quinces; medlars; loquats; grapes; currants",
    "- Ann Lee ... Nurse\n- Bob Ray ... Pilot\n- Cy Young ... Clerk\n- Dee Dow ... Judge\n- Eve Fox ... Baker",
    "title | year | gross\nRiver | 1987 | 123456\nStone | 1990 | 99812\nBridge | 2001 | 771200\nHarvest | 1999 | 88",
    "<td>[[river]]</td><td>{{stone|bridge}}</td><br/><div class=\"x\">[[lake]]</div><td>{{oak|elm}}</td>",
    "=======================~~~~~~~~~~~~~~~~~~~~~~#################=====================",
    "8f3a9c0b77de1245 90aa8b7c6d5e4f3021 77bb00cc99dd 1a2b3c4d5e6f708192 a0b1c2d3e4f5 00ff11ee22dd",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert Profiler().measure(text)["profile"] == "prose"


@pytest.mark.parametrize("text", JUNK)
def test_other_texts(text):
    assert Profiler().measure(text)["profile"] != "prose"


def test_mixtures_go_by_the_larger_part():
    assert Profiler().measure(" ".join(PROSE[:2]) + " " + JUNK[0][:60])["profile"] == "prose"
    assert Profiler().measure(PROSE[0][:60] + "\n" + "\n".join(JUNK[1:3] * 3))["profile"] != "prose"


def test_quality_of_dirty_rows(spark):
    rows = [(1, PROSE[0]), (1, PROSE[0]), (2, None), (3, ""), (4, " \n "), (None, JUNK[0]), (5, "x"), (6, PROSE[0] * 500)]
    df = spark.createDataFrame([(a, b, 1, "y") for a, b in rows], "doc_id bigint, plot string, id int, words string")
    got = {r.id: r for r in text_quality(df).collect()}
    assert len(got) == 7 and {i for i, r in got.items() if r.profile == "empty"} == {2, 3, 4}
    assert got[1].words == 22 and got[1].closed_lines == 1.0 and got[1].lines == 1 and got[2].words == 0 and got[4].chars == 3
    assert got[6].profile == "prose" and got[6].chars == 500 * len(PROSE[0])
    assert text_quality(df.where("false")).count() == 0


def easy(i):
    return " ".join(f"The {a} is {b}. We see a {a}!" for a, b in zip(("dog cat sun hat cup".split() * 4)[i % 5 :][:8], "red big sad new old hot wet shy".split(), strict=True))


def hard(i):
    return " ".join(f"Such {a} necessarily problematizes the {b} of representation;" for a, b in zip(("historiography subjectivity temporality commodification".split() * 4)[i % 4 :][:8], "discontinuity fragmentation legitimation ambiguity simultaneity articulation canonization criticality".split(), strict=True))


def middle(i):
    return " ".join(f"The {a} follows a letter to the {b} before dawn." for a, b in zip(("lawyer sailor widow painter singer".split() * 4)[i % 5 :][:8], "village theatre market station prison garden castle school".split(), strict=True))


def test_levels_of_held_out_texts(spark):
    makers = {"easy": easy, "middle": middle, "hard": hard}
    rows, bands = [], {}
    for k, (band, make) in enumerate(makers.items()):
        for i in range(40 if band == "middle" else 20):
            bands[100 * k + i] = band
            rows.append((100 * k + i, make(i), ("en", "EN", "en-XX")[i % 3]))
    mixed = middle(0) + " " + easy(1)[:30] + " " + middle(2)
    rows += [(900, mixed, "en"), (901, None, "en"), (902, "", "en"), (903, easy(1), "de"), (904, easy(1), None), (905, "12 34", "en"), (None, hard(1), "en"), rows[0], (906, "<b>" + easy(2).replace(". ", ".</b>\n\n<b>") + "</b>", "en")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, lang string, band string, nodes int")
    labels = [(d, b.upper() + " ") for d, b in bands.items() if d % 100 < 5] + [(0, None), (5, "unknown"), (99999, "hard"), (None, "easy")]
    graded = spark.createDataFrame(labels, "doc_id bigint, band string")
    got = {r.doc_id: r for r in reading_levels(docs, graded).collect()}
    assert set(got) == set(bands) | {900, 906}
    held_out = [d for d in bands if d % 100 >= 5]
    assert sum(got[d].band == bands[d] for d in held_out) >= 0.95 * len(held_out)
    assert got[900].band == "middle" and got[906].band == "easy"
    ungraded = reading_levels(docs, graded.where("false")).collect()
    assert len(ungraded) == len(got) and all(r.band is None and r.difficulty is None for r in ungraded)
    assert reading_levels(docs.where("false"), graded).count() == 0


LANGUAGES = {
    "Polish": "Stary latarnik znajduje na strychu list od brata i wyrusza nad morze. W porcie spotyka kobietę, która zna prawdę o dawnym procesie, lecz boi się ją powiedzieć. Zimą oboje wracają do miasteczka, gdzie nikt nie chce pamiętać pożaru.",
    "Russian": "Старый смотритель маяка находит на чердаке письмо брата и отправляется к морю. В порту он встречает женщину, которая знает правду о давнем суде, но боится её сказать. Зимой они вместе возвращаются в город, где никто не хочет вспоминать о пожаре.",
    "Turkish": "Yaşlı fener bekçisi tavan arasında kardeşinin mektubunu bulur ve denize doğru yola çıkar. Limanda eski davanın gerçeğini bilen ama söylemekten korkan bir kadınla tanışır. Kışın birlikte kimsenin yangını hatırlamak istemediği kasabaya dönerler.",
    "Japanese": "年老いた灯台守は屋根裏で弟からの手紙を見つけ、海へ向かう旅に出る。港で彼は、昔の裁判の真実を知りながら話すことを恐れている女性に出会う。冬になると二人は、誰も火事を思い出したがらない町へ一緒に帰る。",
    "Portuguese": "O velho faroleiro encontra no sótão uma carta do irmão e parte para o mar. No porto conhece uma mulher que sabe a verdade sobre o antigo julgamento, mas tem medo de a dizer. No inverno os dois voltam à vila, onde ninguém quer lembrar o incêndio.",
    "Swedish": "Den gamle fyrvaktaren hittar ett brev från sin bror på vinden och ger sig av mot havet. I hamnen möter han en kvinna som vet sanningen om den gamla rättegången men inte vågar berätta den.",
    "Greek": "Ο γέρος φαροφύλακας βρίσκει στη σοφίτα ένα γράμμα του αδελφού του και ξεκινά για τη θάλασσα. Στο λιμάνι συναντά μια γυναίκα που ξέρει την αλήθεια για την παλιά δίκη αλλά φοβάται να την πει.",
    "Korean": "늙은 등대지기는 다락방에서 동생의 편지를 발견하고 바다로 떠난다. 그는 항구에서 오래된 재판의 진실을 알지만 말하기를 두려워하는 여자를 만난다. 겨울이 되자 두 사람은 아무도 화재를 기억하고 싶어 하지 않는 마을로 돌아간다.",
    "Arabic": "يجد حارس المنارة العجوز رسالة من أخيه في العلية ويرحل نحو البحر. في الميناء يلتقي بامرأة تعرف حقيقة المحاكمة القديمة لكنها تخاف أن تقولها. في الشتاء يعودان معا إلى البلدة التي لا يريد أحد فيها أن يتذكر الحريق.",
}
OTHERS = {
    "list": "lantern, harbor, ledger, baker, old mill, quarry, widow, festival, strike, harvest, bargain, checkpoint, trophy, portrait, uniform",
    "cast": "- Anna Lindqvist: Baker\n- Tom Reyes: Sailor\n- Mia Okafor: Judge\n- Lars Holm: Clerk\n- Ines Prado: Widow\n- Jon Vik: Pilot",
    "table": "title\tyear\tgross\nFerry\t1984\t4428410\nQuarry\t1971\t2214556\nHarbor\t1989\t2384566\nLedger\t1999\t241519",
    "markup": '<div class="a">boat</div><br/>[[ferry]]{{miner|smuggler}}<td>reservoir</td>&nbsp;[[violin]]<div>necklace</div>{{judge|boxer}}',
    "letters": "bz jvlchmnw dcbwb zntpv zsdbbqp kvvkbl ns fgqjhhr hsz ftvns flbzc zrf nrstjl jvm mxn mnzkcgvx sstdcj bhfz zgcsqf nbh jgffk vbqg",
    "codes": "b8738cff32c c4110ba3bb91030c9a2b945275ffc99 ff978cf98d1eafd7228 3e59bdf8f5055a2da0 23fc4afa 09500a88bcbe0ae14076228a0d",
    "symbols": "*********** ~~~~~~~~ ########## ______ ------- ====== ++++++ ******* ~~~~~ ####### _____",
    "repeated": "candle agent checkpoint scar pension waiter " * 12,
}


def test_prose_in_languages_that_no_table_lists(spark):
    rows = [(i, t) for i, t in enumerate([*LANGUAGES.values(), *OTHERS.values()])]
    got = {r.id: r for r in text_quality(spark.createDataFrame(rows, "doc_id bigint, plot string")).collect()}
    for i, name in enumerate([*LANGUAGES, *OTHERS]):
        assert (got[i].profile == "prose") == (name in LANGUAGES), (name, got[i])


def test_words_of_a_collection(spark):
    rng = random.Random(2)
    nouns = ["harbor", "ledger", "baker", "quarry", "widow", "ferry"]
    prose = [f"the {rng.choice(nouns)} of the {rng.choice(nouns)} is for the {rng.choice(nouns)} and the {rng.choice(nouns)}" for _ in range(300)]
    lists = [", ".join(rng.choice(nouns) for _ in range(12)) for _ in range(60)]
    known = known_words(spark.createDataFrame([(t,) for t in prose + lists], "text string"))
    assert {w for w, function in known.items() if function} == {"the", "of", "is", "for", "and"} and set(known) >= set(nouns)
    bare = " ".join(rng.choice(nouns) for _ in range(40))
    assert [m["profile"] for m in Profiler(known).measure_all([prose[0], bare])] == ["prose", "list"]
