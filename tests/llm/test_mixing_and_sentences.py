import random

import pytest
from pyspark.sql import functions as F

from loamql.llm import mixing as m
from loamql.llm.sentences import sentence_units, units

TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, sizes, seed=3):
    rng = random.Random(seed)
    rows = [(n, s, t, rng.expovariate(1.0)) for n, (s, t) in enumerate((s, t) for s, ts in sizes.items() for t in ts)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, key double"), rows


def plain(rows, targets):
    total = sum(r[2] for r in rows)
    picks = {}
    for source, share, repeats in targets:
        docs = sorted((k, d, t) for d, s, t, k in rows if s == source and t > 0)
        have, budget = sum(d[2] for d in docs), int(share * total)
        if not have:
            continue
        epochs = min(budget // have, repeats)
        rest = budget - epochs * have if epochs < repeats else 0
        run, fits = 0, True
        for _, d, t in docs:
            run += t
            fits = fits and run <= rest
            if epochs + fits:
                picks[d] = epochs + fits
    return picks


@pytest.mark.parametrize(("octave", "fine"), [(1, 0), (8, 2), (512, 12)])
def test_mix_against_a_plain_version(spark, octave, fine):
    rng = random.Random(1)
    df, rows = sized(spark, {"a": [rng.randrange(1, 40) for _ in range(400)], "b": [rng.randrange(0, 9) for _ in range(60)], "c": [5] * 3, None: [7] * 20})
    targets = [("a", 0.4, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("d", 0.1, 5)]
    picks, report = m.mix(df, spark.createDataFrame(targets, TARGETS), octave, fine)
    got = {r.doc_id: r.copies for r in picks.collect()}
    assert got == plain(rows, targets)
    by = {r.source: r for r in report.collect()}
    assert by["c"].most_copies == 2 and by["c"].shortfall_tokens > 0 and by["d"].used_tokens == 0
    assert sum(r.share_of_mix for r in by.values()) == pytest.approx(1.0)
    tokens = {r[0]: r[2] for r in rows}
    assert sum(r.used_tokens for r in by.values()) == sum(tokens[d] * c for d, c in got.items())


@pytest.mark.parametrize("weight", [1.0, 0.1, 0.01])
def test_buckets_are_small_whatever_the_weights(spark, weight):
    keys = spark.range(200_000).select(m.es_key(F.lit(weight), F.col("id")).alias("key"))
    buckets = keys.groupBy(F.floor(F.log2("key") * m.OCTAVE).alias("b")).count()
    assert buckets.agg(F.max("count")).first()[0] < 200_000 / 1000


def test_equal_keys_and_repeated_rows(spark):
    df = spark.createDataFrame([(n // 2, "a", 1, 0.5) for n in range(40)], "doc_id bigint, source string, tokens bigint, key double")
    picks, report = m.mix(df, spark.createDataFrame([("a", 0.5, 1)], TARGETS))
    assert sorted(r.doc_id for r in picks.collect()) == [n // 2 for n in range(20)] and report.first().used_tokens == 20


def test_empty_and_untokenised(spark):
    df, _ = sized(spark, {"a": [0, 0]})
    targets = spark.createDataFrame([("a", 1.0, 3)], TARGETS)
    picks, report = m.mix(df, targets)
    assert picks.collect() == [] and report.first().used_tokens == 0
    picks, report = m.mix(df.limit(0), targets)
    assert picks.collect() == [] and report.first().target_tokens == 0


def test_tokens_labels_and_weights(spark):
    docs = spark.createDataFrame([(1, "Hello world, hello!", " Plenary_Record "), (2, None, None), (3, "", "x"), (4, "!!! 12 ???", "x"), (5, "word " * 100, "x"), (6, " ".join(chr(97 + n % 26) * (2 + n // 26) for n in range(100)), "x"), (7, "a" * 300, "x")], "doc_id bigint, text string, source string")
    rows = {r.doc_id: r for r in m.sized_documents(docs).collect()}
    assert rows[1].source == "plenary_record" and rows[1].tokens == 5 and rows[2].tokens == rows[3].tokens == 0 and rows[5].tokens >= 100
    assert all(r.key > 0 for r in rows.values())
    weights = {r.doc_id: r.w for r in docs.select("doc_id", m.quality("text").alias("w")).collect()}
    assert weights[6] == 1.0 and weights[5] < 0.1 and weights[7] == 0.01 and weights[2] == weights[3] == 0.01 and weights[4] < weights[1] < 1


def test_heavier_documents_come_first_more_often(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    keyed = df.withColumn("k", m.es_key(F.col("w"), F.col("id"))).orderBy("k").limit(1000)
    assert 680 < keyed.filter("w = 3").count() < 800


def texts(text):
    return [text[a:b] for a, b in units(text)]


CASES = {
    "abbreviations": ["Mr. Ode met Dr. J. K. Bega, M.P. for Yakri, at 10.30 a.m. in Room No. 7.", "It concerns roads, etc.", "The sitting closed at 5 p.m.", "See vol. 105, pp. 35-228, of the Papers."],
    "german": ["Am 3. Mai 1993 kamen wir zur 43. Sitzung zusammen.", "Die Kosten stiegen um 57,2 Prozent, d. h. um 14,0 Mio. Taler, in Gavel.", "Es geht um Wege usw.", "Siehe S. 37 ff. der Akten.", "Delfen sagte: „Das reicht nicht. Wir bleiben.“", "„Ist das so?“, fragte der Abg. Olvar."],
    "french": ["« Est-ce vrai ? » demanda le Dr. Zobota.", "Selon l’art. 181, al. 2, de la loi, Calsku reste un port.", "Nous avons attendu... et attendu le rapport.", "Brino a dit : « Cela suffit. Nous restons. »", "La charte oblige M. Xaloel."],
    "russian": ["Речь о дорогах и т.\nд. Мы ждали... и ждали.", "Баол сказал: «Этого мало. Мы остаёмся».", "«Это так?» — спросил деп. Олвар.", "В 1995 г. в Оляр прошло 95-е заседание.", "И. К. Нормел требует ст. 39 п. 2 закона."],
    "quotes": ['The paper says "no further delay. None at all." and then ends.', 'Torxa told us: "we rejected it. We shall not yield."', '"Is that so?" asked Mrs. Dudu.', "Only “X of Y. Then more”, was struck out.", "What a shambles, Besku?!"],
    "remarks in the wrong place": ["See vol. (Applause.) 105, pp. [Laughter] 35-228.", "Am 3. [Heiterkeit] Mai kam No. (Zuruf: Nein! Nie.) 7 an.", '"Is that so?" (Applause.) asked J. [Laughter] K. Bega.'],
    "remarks": ["The cost rose (Interruption: That is not true! Sit down.) by 19.0 per cent.", "(Shouts of “Shame!” from the RVT)", "[Laughter on the left]", "We meet again."],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_sentences(name):
    if name == "russian":
        want = [*CASES[name][1:], *["Речь о дорогах и т.\nд.", "Мы ждали... и ждали."]]
        assert texts(" ".join([*CASES[name][1:], CASES[name][0]])) == want
        return
    assert texts(" ".join(CASES[name])) == CASES[name]
    assert texts("\n".join(CASES[name])) == CASES[name]


def test_uncased_scripts():
    zh = ["“真的吗？”黎岚的翎澜议员问道。", "我们等了又等……等的是水务税。", "珂芷棠议员说：“这还不够。我们不会让步。”", "依照《昶湄芷法》第198条第2款，昶渝峤筠是港口。", "（插话：不对！坐下。）", "这太不公平了！"]
    assert texts("".join(zh)) == zh
    ja = ["「本当ですか？」とタメ選出のタサ君が尋ねた。", "メブ君は「これでは足りない。譲らない。」と述べた。", "（「違う！座れ。」と呼ぶ者あり）", "〔笑声〕", "私たちは待ち……さらに待ちました。"]
    assert texts("".join(ja)) == ja
    hi = ["वापो ने कहा, “यह काफी नहीं है। हम नहीं झुकेंगे।” और बैठ गए।", "“क्या यह सच है?” लावारो के वासामा ने पूछा।", "डॉ. देसू ने कहा।"]
    assert texts(" ".join(hi)) == hi
    ar = ["«أهذا صحيح؟» سأل النائب رودا من زاجا.", "قال سانالي: «هذا لا يكفي. لن نتراجع.»", "بموجب م. 195 من قانون ليفا تبقى ميناء."]
    assert texts(" ".join(ar)) == ar
    th = ["ค่าใช้จ่ายเพิ่มขึ้น 69.8 ล้านที่บาดากา", "เรื่องต่างๆ ของโนบา", "มาสากล่าวว่า “ไม่พอ เราไม่ยอม” ต่อสภา", "(มีผู้ขัดจังหวะว่า ไม่จริง นั่งลง)", "คณะทำงาน"]
    assert texts(" ".join(th)) == th


def test_layout():
    assert texts("The President: We begin.\n\nItem 34: Bill, second reading\n\nIt rose\nby 3.5 per cent\r\n\r\n  Last one ") == ["The President:", "We begin.", "Item 34: Bill, second reading", "It rose\nby 3.5 per cent", "Last one"]
    assert texts("Dr. Duro (SKA) : « Est-ce vrai ? » demanda Ode.") == ["Dr. Duro (SKA) :", "« Est-ce vrai ? » demanda Ode."]
    for head, rest in (("The President:", '"Is that so?" asked Mrs. Ode.'), ("Mme la présidente :", "« Est-ce vrai ? » demanda Ode."), ("主席：", "“真的吗？”黎岚的翎澜议员问道。"), ("Präsident:", "„Ist das so?“, fragte Ode.")):
        assert texts(f"{head} {rest}") == [head, rest]
    for whole in ("Брино сказал: «Этого мало. Мы остаёмся».", "Brino a dit : « Cela suffit. Nous restons. »", "珂芷棠议员说：“这还不够。我们不会让步。”", "قال سانالي: «هذا لا يكفي. لن نتراجع.»"):
        assert texts(whole) == [whole]
    assert texts('Torxa told us: "No. Never."') == ['Torxa told us: "No. Never."']
    assert texts("Item 34: Bill") == ["Item 34: Bill"]
    assert texts("It fell in 1922.The House met.We left.") == ["It fell in 1922.", "The House met.", "We left."]
    assert texts("They met.Mr. Ode left.Dr.\nBega spoke.") == ["They met.", "Mr. Ode left.", "Dr.\nBega spoke."]
    assert texts('He said "no. It') == ['He said "no.', "It"]
    assert texts("(a b") == ["(a b"] and texts("...") == ["..."] and texts("a.b.c d. e") == ["a.b.c d. e"]


LISTS = [
    ["1. First item", "2. Second item"], ["(1) Erstens gilt das.", "(2) Zweitens nicht."], ["1.1. Minutes."], ["Intro:", "1. First", "2. Second one.", "And more.", "3. Third"], ["ii. Text here"], ["(a) Text here"],
    ["a) one;", "b) two:", "  i) deep", "  ii) deeper", "c) three"], ["• one", "• two"], ["1. A", "1.1. B", "1.2. C", "2. D"], ["i. one", "ii. two", "iii. three", "iv. four"], ["h) eight", "i) nine", "j) ten"],
    ["1. one", "1. one more"], ["1) She said (2) and “3. Nothing.\n2) More” then.", "2) Next"],
]


@pytest.mark.parametrize("items", LISTS)
def test_lists(items):
    assert texts("\n".join(items)) == [i.strip() for i in items]


def test_numbers_that_are_no_markers():
    for whole in ("Wir kamen am\n3. Mai 1993 an.", "It was\n(applause)\nfine.", "The sum of\n2) and 3) is 5.", "Nothing\n• here."):
        assert texts(whole) == [whole]


@pytest.mark.parametrize("text", ["Wort („a ", "x) „a“ ", "( a", '"a ', "(a) ", "\n1. x", "\n(1) x", "a" * 500 + ". ", "A.", "т. ", "3. ", ") т. д. "])
def test_time_grows_with_the_length_only(text):
    import time

    def took(n):
        began = time.perf_counter()
        units(text * (n // len(text)))
        return time.perf_counter() - began

    assert took(1_000_000) < 25 * max(took(100_000), 0.02)


def test_long_labels_and_words():
    name = " ".join(["Delbrimelesh"] * 20)
    assert texts(f"{name}: We begin.") == [f"{name}:", "We begin."]
    assert texts(f"{'k' * 100}. Then 5. Mai.")[0] == f"{'k' * 100}."


def test_offsets_and_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "😀 One. 😀 Two."), (4, "😀 One. 😀 Two."), (5, "word " * 200_000 + "end.")]
    got = sorted(tuple(r) for r in sentence_units(spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as start_char")).collect())
    assert got == [(4, 0, 6), (4, 0, 6), (4, 7, 13), (4, 7, 13), (5, 0, 1_000_004)]


def test_units_cover_the_text_in_order():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["A", "b", ".", "!", "?", '"', "“", "”", "(", ")", " ", "\n", "3", "。", "」", "「", "…", ":", "ก", "Mr", "é"]) for _ in range(rng.randrange(40)))
        found = units(text)
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        assert "".join("".join(text[a:b].split()) for a, b in found) == "".join(text.split())
