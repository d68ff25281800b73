import random

import numpy as np
import pytest

from loamql.llm import leakage as L

rng = random.Random(6)
SYLLABLES = "tel mar bri sel kor lan vo dor gal pen xa ru nim".split()


def word(n=3):
    return "".join(rng.choice(SYLLABLES) for _ in range(n))


def passage(words):
    return " ".join(word(rng.choice([1, 2, 3])) for _ in range(words))


ITEMS = [(n, passage(40)) for n in range(30)]
CJK = [(100 + n, "".join(rng.choice("禾湄黎楹峤樾芷沅岑寰澜邑翎珂渚屹铎昶渝穆棠筠泽岚") for _ in range(90))) for n in range(5)]
THAI = [(200, "กฎบัตรเกลาคูบาของรูเวเรปากำหนดให้ท่าราปาเลมาและโรงสีบาซูเรเวชำระคืนเมเกเรวา ระหว่างรูนาสาซูกับโนโมวาโกคลองคูมาปาปาขนเรือ")]


@pytest.fixture(scope="module")
def finder():
    return L.Finder(L.Items([*ITEMS, *CJK, *THAI, (300, None), (301, ""), (302, "—!?")]))


def found(finder, text):
    return [i for _, i in finder.find([text])]


def around(text):
    return f"{passage(30)}. {text} {passage(25)}."


def test_whole_and_part(finder):
    words = ITEMS[3][1].split()
    assert found(finder, around(ITEMS[3][1])) == [3]
    assert found(finder, around(" ".join(words[10:26]))) == [3]
    assert found(finder, around(" ".join(words[5:15]))) == []
    assert found(finder, around(f"{ITEMS[3][1]} {passage(20)} {ITEMS[4][1]}")) == [3, 4]


def test_two_short_pieces_apart_are_no_case(finder):
    words = ITEMS[5][1].split()
    assert found(finder, around(f"{' '.join(words[:10])} {passage(60)} {' '.join(words[10:20])}")) == []


def test_altered_words(finder):
    for n in range(20):
        words = ITEMS[n][1].split()[12:28]
        for at in (4, 11):
            words[at] = word()
        assert found(finder, around(" ".join(words))) == [n]
        for at in (1, 7, 9, 13):
            words[at] = word()
        assert found(finder, around(" ".join(words))) == []


def test_outward_changes(finder):
    text = " ".join(ITEMS[7][1].split()[3:22])
    changed = [
        text.upper(), text.replace(" ", "\n"), text.replace("a", "á").replace("o", "ö"), "".join(f"{c}​" for c in text), text.replace(" ", ", — "), text.replace(" ", "   \t"),
        "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in text), " ".join(w[: len(w) // 2] + "-\n" + w[len(w) // 2 :] for w in text.split()), text.replace(" ", ""),
        " ".join([*text.split()[:6], "(Interruption: That is not true! Sit down.)", *text.split()[6:12], "[Laughter (on the left)]", *text.split()[12:]]),
        f"({text})",
    ]
    assert [found(finder, around(t)) for t in changed] == [[7]] * len(changed)


def test_scripts_without_blanks(finder):
    item = CJK[2][1]
    assert found(finder, f"动议获得通过。{item[20:61]}。湄筠的昶珂") == [102]
    altered = list(item[20:70])
    for at in (5, 14, 23, 32, 41):
        altered[at] = "口"
    assert found(finder, f"动议获得通过。{'，'.join(altered)}。") == [102]
    assert found(finder, f"动议获得通过。{item[20:45]}。湄筠的昶珂") == []
    assert found(finder, "ประธาน " + THAI[0][1][10:70].replace("ของ", "ของ ​")) == [200]


def test_null_empty_and_equal_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, around(ITEMS[1][1]), "x"), (4, None, "y"), (5, ITEMS[1][1] * 60, "z")], "doc_id bigint, text string, item_id string")
    docs = docs.unionAll(docs.filter("doc_id = 3").selectExpr("6L", "text", "item_id"))
    items = spark.createDataFrame([*ITEMS[:3], (50, ITEMS[1][1]), (51, None)], "item_id bigint, text string")
    got = sorted(tuple(r) for r in L.leaks(docs, items).collect())
    assert got == [(d, i) for d in (3, 5, 6) for i in (1, 50)]
    report = {r.item_id: r.n_documents for r in L.leak_report(docs, items).collect()}
    assert report == {0: 0, 1: 3, 2: 0, 50: 3, 51: 0}
    assert L.leaks(docs.limit(0), items).collect() == [] and L.leaks(docs, items.limit(0)).collect() == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(n, around(ITEMS[n][1])) for n in range(8)], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    monkeypatch.setattr(L, "BLOCK_ITEMS", 7)
    found = L.leaks(docs, items)
    assert sorted(tuple(r) for r in found.collect()) == [(n, n) for n in range(8)]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_many_items_are_one_pass(spark):
    items = spark.range(0, 12_000).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(1, 24), x -> substr(md5(concat(id, '/', x)), 1, 6))) as text")
    docs = items.filter("item_id % 500 = 7").selectExpr("item_id as doc_id", "concat('Here it is. ', text, '. And more.') as text").repartition(2)
    found = L.leaks(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [(n, n) for n in range(7, 12_000, 500)]


def test_bracketed_passages(finder):
    assert found(finder, f"动议获得通过。（{CJK[1][1][20:66]}）湄筠的昶珂") == [101]
    words = ITEMS[9][1].split()
    assert found(finder, around(f"[{' '.join(words[3:20])}]")) == [9]
    deep = " ".join([*words[:8], "(a [b (c [d (e) f] g) h] i)", *words[8:17]])
    assert found(finder, around(deep)) == [9]
    open_only = " ".join([*words[:8], "(", *words[8:17]])
    assert found(finder, around(open_only)) == [9]


def test_items_with_brackets():
    inner, outer = passage(24), passage(30)
    finder = L.Finder(L.Items([(1, f"Question: what ({inner})?"), (2, f"{outer} (Applause.)"), (3, "Question: what (now)?")]))
    assert found(finder, around(inner)) == [1] and found(finder, around(f"({inner})")) == [1]
    assert found(finder, around(outer)) == [2]
    assert found(finder, around("Question: what is this, applause")) == []
    words = inner.split()
    assert found(finder, around(f"Question: what {' '.join(words[:14])}")) == [1]


def test_long_items_are_cut(finder):
    long = passage(3000)
    items = L.Items([(1, long)])
    assert max(len(c) for c in items.codes) < 192 * 12 and len(items.ids) > 15
    finder, words = L.Finder(items), long.split()
    for begin in range(0, 2980, 97):
        assert found(finder, around(" ".join(words[begin : begin + 16]))) == [1]


def test_many_brackets_take_linear_time():
    import time

    began = time.perf_counter()
    text = "a (b " * 200_000
    assert L.without_remarks(text) == [text] and L.without_remarks("(" * 300_000 + "x" + ")" * 300_000) == [""]
    assert time.perf_counter() - began < 5


def test_words_of_one_letter():
    """Where a window leaves no eight letters in a row, shorter q-grams are taken."""
    text = " ".join("abcdefghijklmnopqrstuvwxyz"[n * 7 % 26] for n in range(40))
    items = L.Items([(1, text)])
    assert not len(items.index[1][0]) and len(items.index[0][0])
    assert found(L.Finder(items), f"xx yy. {text}. zz") == [1]


def test_bounds_hold_for_the_worst_alteration():
    items = L.Items(ITEMS[:4])
    for n in range(4):
        hashes, entry, place, _ = items.index[1]
        chosen = np.zeros(len(items.codes[n]), bool)
        chosen[place[entry == n]] = True
        words = items.words[n]
        for start in range(0, int(words[-1]) + 2 - L.WORDS, 5):
            for lost in ((start + 3, start + 9), (start + 7, start + 8), (start, start + 15)):
                alive = [p for p in np.flatnonzero(chosen) if words[p] >= start and words[p + L.Q_SPACED - 1] < start + L.WORDS and not any(words[p] <= w <= words[p + L.Q_SPACED - 1] for w in lost)]
                assert len(alive) >= items.need[n]


def test_run_of_mostly_good():
    assert L._long_run(np.array([True] * 16), 16) and not L._long_run(np.array([True] * 10 + [False] * 20), 16)
    assert L._long_run(np.array([False] * 5 + [True] * 7 + [False] + [True] * 8 + [False] * 9), 16)
    assert not L._long_run(np.array([True, False] * 20), 16) and L._long_run(np.array([True] * 5), 16)
