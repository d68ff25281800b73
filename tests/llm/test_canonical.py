import random

import pytest

from loamql.llm import canonical as c

ENTRIES = [
    (1, "United Cantons of Nojoror", "UOF", "Пелфаржакор"), (2, "Republic of Elzöstan", "RSE", "Падазарпа"), (3, "Delrenia", "DLY", "Ивулренба"), (4, "Saint Cordorheim", "SMT", "زاجادالي"),
    (5, "Kamomark Islands", "KDM", "ノミロヴェ"), (6, "New Corcalia", "NWY", "सालालाली"), (7, "Corcalia", "CLX", "Sarataka"), (8, "Grand Duchy of Vojorgaova", "GRV", None),
    (9, "Democratic Republic of Vojorgaova", "DAA", None), (10, "Lotorique and Skurenland", "LAE", None), (11, "Lotorique", None, ""), (12, None, None, None),
]
# more entries, from which the common words are learned
PATTERNS = ["United Cantons of {}", "Republic of {}", "Saint {}", "{} Islands", "New {}", "Grand Duchy of {}", "Democratic Republic of {}", "{} and {}"]
ENTRIES += [(100 + 10 * n + k, p.format(f"{a}ub{b}iq", f"{b}up{a}is"), None, None) for n, p in enumerate(PATTERNS) for k, (a, b) in enumerate([(chr(98 + n) + "e", "w"), ("y", chr(98 + n) + "a"), ("fl", chr(98 + n) + "o")])]


@pytest.fixture(scope="module")
def index():
    return c.Index(ENTRIES)


def meant(index, value):
    best = index.best(value)
    return 0 if not best or len(best) > 1 and best[0][0] - best[1][0] < c.MARGIN else best[0][1]


SPELLINGS = {
    1: ["Nojoror", "utd. cantons of nojoror", "UNITED CANTОNS OF NОJOROR", "nOJOROR, uNITED cANTONS OF", "UOF", "UOF: United Cantons of Nojoror", "UnitedCantonsofNojoror", "United_Cantons_of_Nojoror", "U&#110;ited Cantons of Nojoror", "Пелфаржакор", "Unitend Cantons pof Nojoro", '"United  Cantons of Nojoror"', "Un1ted Cant0ns of N0joror"],
    2: ["Elzöstan", "Rep. Elzostan", "Repub. of Elzöstan [1]", "Падазарпа / Republic of Elzöstan", "ELZÖSTAN, REPUBLIC", "Republic nof Elzöstann", "rse", "Republic of Elzöstan (RSE)", "REPUBLIC\xa0OF\xa0ELZÖSTAN"],
    3: ["State of Delrenia", "The Republic of Delrenia", "Delrnia", "dElRENIA.", "the Delrenia", "Delrenia (mainland)", "Dеlrеniа", "Ивулренба", "Del​renia", "Ｄｅｌｒｅｎｉａ"],
    4: ["St. Cordorheim", "Cordorheim", "Cordorheim, Saint", "Saint Cordorheirn", "زاجادالي"],
    5: ["Kamomark", "Kamomark Isl.", "KAMOMARK IS.", "Kmomark Islands", "ノミロヴェ"],
    6: ["New Corcalia", "Corcalia, New", "Nw Corcalia", "NEWW CORCALIA"],
    7: ["the Corcalia", "Corcalla", "Sarataka", "Kingdom of Corcalia"],
    8: ["Grand Duchy of Vojorgaova ", "Gr. Duchy of Vojorgaova", "G.D. of Vojorgaova"],
    9: ["Dem. Rep. of Vojorgaova"],
    10: ["Lotorique & Skurenland", "Lotorique + Skurenland"],
    11: ["Lotorique "],
    0: ["Vojorgaova", "unknown", "N/A", "-", "42", "Tasarenville", "Bolodor-on-Sea", "Republic", "of", "AMBER COAST", "{}", "?", "Delducorya", "xyz"],
}


@pytest.mark.parametrize("entry", sorted(SPELLINGS))
def test_spellings(index, entry):
    assert {v: meant(index, v) for v in SPELLINGS[entry]} == dict.fromkeys(SPELLINGS[entry], entry)


def test_edits_against_a_plain_version():
    def plain(a, b):
        d = {(-1, -1): 0} | {(i, -1): i + 1 for i in range(len(a))} | {(-1, j): j + 1 for j in range(len(b))}
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
                if i and j and x == b[j - 1] and a[i - 1] == y:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in "12")
        assert c.edits(a, b, 3) == min(plain(a, b), 4)


def test_misspelt_names_are_found():
    rng = random.Random(8)
    syllables = "tel mar bri sel kor lan vo dor gal pen xa ru".split()
    names = sorted({"".join(rng.choice(syllables) for _ in range(4)).capitalize() for _ in range(150)})
    index = c.Index([(n + 1, name, None, None) for n, name in enumerate(names)])
    right = 0
    for _ in range(400):
        n = rng.randrange(len(names))
        text = list(names[n])
        at = rng.randrange(1, len(text) - 1)
        text[at : at + 1] = rng.choice([[], [text[at]] * 2, [rng.choice("qwz")]])
        right += meant(index, "".join(text)) == n + 1
    assert right >= 390


def test_candidates_are_not_capped():
    rng = random.Random(4)
    others = [(n + 100, "".join(rng.choice("bdfghkpst") + rng.choice("eiu") for _ in range(4)), None, None) for n in range(200)]
    index = c.Index([*((n + 2, f"Marovl{chr(97 + n)}", None, None) for n in range(12)), (1, "Marovail", None, None), *others])
    places, cos = index.cosines(0, "marovlal")
    assert sum(cos > cos[places.tolist().index(12)]) >= 9
    assert {index.entry[n] for n in places} == set(range(1, 14))


def test_threshold_and_margin_decide(index, monkeypatch):
    assert meant(index, "Ddlrenai") == 3
    monkeypatch.setattr(c, "THRESHOLD", 0.9)
    assert meant(index, "Ddlrenai") == 0 and meant(index, "Delrenia") == 3
    monkeypatch.setattr(c, "THRESHOLD", 0.3)
    monkeypatch.setattr(c, "MARGIN", 0.5)
    assert meant(index, "Corcalia") == 0


def test_common_words_are_learned(index):
    assert set(index.common.weight) == {"united", "cantons", "republic", "of", "saint", "islands", "new", "grand", "duchy", "democratic", "and"}
    assert index.common.links == {"cantons", "duchy", "of"}
    assert ("grand", "duchy") in index.common.initials["gd"]


def test_another_list():
    """Cities, with common words of their own."""
    rng = random.Random(3)
    stems = sorted({"".join(rng.choice("bru can del fo gir hal jo kem lur mon nar pos quel rin".split()) for _ in range(3)).capitalize() for _ in range(120)})
    kinds = ["{}", "Port {}", "{} Falls", "Upper {}", "{} Springs"]
    entries = [(n + 1, kinds[n % 5].format(s), f"C{n:03d}", None) for n, s in enumerate(stems)]
    index = c.Index(entries)
    assert set(index.common.weight) == {"port", "falls", "upper", "springs"}
    right = 0
    for n, name, _, _ in entries:
        shown = [name.upper(), name.replace("Port", "Prt").replace("Springs", "Spr.").replace("Upper", "Uper"), name[:4] + name[5:], f" {name} (C{n - 1:03d})"]
        right += sum(meant(index, v) == n for v in shown)
    assert right >= 0.99 * 4 * len(entries)
    assert [meant(index, v) for v in ("Zwolle Falls", "Upper", "Springfield", "unknown")] == [0, 0, 0, 0]


def test_letters_alike_are_not_doubled_ones():
    assert c.misspelt("udelineey", "ufeney", 2) == 3 and c.misspelt("corcaila", "corcalla", 2) == 0


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    values = spark.createDataFrame([(v,) for v in ("Delrnia", "Kmomark Islands", "Corcalla", "Lotorique")], "value string")
    entries = spark.createDataFrame(ENTRIES, "country_id int, country string, iso_code string, local_name string")
    whole = {r.value: (r.entry, round(r.score, 9)) for r in c.match_values(values, entries).collect()}
    monkeypatch.setattr(c, "BLOCK_ENTRIES", 3)
    assert {r.value: (r.entry, round(r.score, 9)) for r in c.match_values(values, entries).collect()} == whole


@pytest.mark.parametrize("block", [20_000, 4])
def test_rows(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK_ENTRIES", block)
    values = ["Delrenia", None, "", "   ", "Delrnia", "Delrnia", "nowhere", "\t", "UOF", "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(values)), "ranking_id bigint, country string").selectExpr("*", "1 as entry", "2 as score", "country as value")
    entries = spark.createDataFrame(ENTRIES, "country_id int, country string, iso_code string, local_name string")
    got = {r.ranking_id: r.country_id for r in c.map_countries(rows, entries).collect()}
    assert got == {4: 3, 5: 3, 6: 0, 7: 0, 8: 1, 9: 0}


def test_empty(spark):
    none = spark.createDataFrame([], "country_id int, country string, iso_code string, local_name string")
    rows = spark.createDataFrame([(1, "x")], "ranking_id bigint, country string")
    assert [tuple(r) for r in c.map_countries(rows, none).collect()] == [(1, "x", 0)]
    assert c.map_countries(rows.limit(0), none).collect() == []
