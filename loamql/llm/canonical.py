"""Mapping freely typed values to the entries of a reference list.

Values are deduplicated and normalised; candidates come from an inverted index of character n-grams
and are scored by the weighted cosine of their n-grams. All of a cosine of at least THRESHOLD are
looked at, an exact check of their edit distance follows, and the best is accepted if its score is
above the next entry's by MARGIN; a value without such a candidate means no entry.

Normalising undoes what doesn't change a name: HTML entities, compatibility and invisible characters,
case, accents of Latin letters, look-alike letters of another script, digits for letters, quotes,
footnotes, separators. A value like "name (local)", "CODE: name" or "local / name" has several
readings, of which the best counts.

Nothing is known of any list beforehand: words that many entries share ("republic", "city", "senior")
are learned from the list, each of at least COMMON_SHARE of the entries and COMMON_LEAST. In a value
such words, also shortened or misspelt ones, are set apart, so that the rest, the core, is compared by
itself. Common words that only follow others ("of") are links, and an unknown word before a link stands
for a common one. The common words are a part of the score, so they decide where entries share a core.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamql.session import shuffle_width

THRESHOLD = 0.3  # least weighted cosine of a candidate's n-grams
MARGIN = 0.02  # least distance of its score to the next entry's
EDIT_COST = 0.1  # what each edit that the exact check finds takes off a candidate's score
ARTICLES = frozenset({"the"})  # words that may stand before any name
CORE_SHARE = 0.8  # of the score; the rest is for the common words
COMMON_SHARE, COMMON_LEAST = 0.01, 3  # of the entries that share a common word, and how many at least
BLOCK_ENTRIES = 20_000  # entries of the reference list that one index holds
GRAM_BITS = 18  # n-grams are counted in so many hash buckets, so the counts' size is bounded

# Cyrillic and Greek letters, and the Latin ones that they look like.
LOOKS = str.maketrans("аеорсхуікмнтвѕјԁһԛԝӏзгАЕОРСХУІКМНТВЅЈЗοανιρυκτεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyikmhtbsjdhqwl3rAEOPCXYIKMHTBSJ3oavipukteABEZHIKMNOPTYX")
BACK = str.maketrans("aeopcxyikmtbAEOPCXYIKMHTB", "аеорсхуікмтвАЕОРСХУІКМНТВ")
DIGITS = str.maketrans("013457", "olesat")

_LATIN, _CYRILLIC = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[Ѐ-ӿ]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_PARTS = re.compile(r"[/()\[\]{}|:：（）［］]|\s[-–—]\s")
_REPEATED = re.compile(r"(.)\1+")
_WORDS = re.compile(r"[^\W_]+(?:[̀-ͯऀ-ॿ่-๎]*[^\W_]*)*|[&+]")
_INITIALS = re.compile(r"(?:\b[^\W\d_](?:\.\s?|\s)){2,}")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours, or most + 1 if it is above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def allowed(length: int) -> int:
    """Edits of a core of so many characters that still are misspellings."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else 3


def plain(text: str) -> str:
    """One script per text, folded: no case, accents on Latin letters or invisible characters."""
    if _LATIN.search(text) and not text.isascii():
        as_latin, as_cyrillic = text.translate(LOOKS), text.translate(BACK)
        # whichever script the whole can be, Latin first, else the one that leaves less of the other
        rest, back = len(_CYRILLIC.findall(as_latin)), len(_LATIN.findall(as_cyrillic))
        text = as_latin if rest == 0 or rest <= back else as_cyrillic
    text = unicodedata.normalize("NFD", text.casefold())
    out = []
    for ch in text:
        if "̀" <= ch <= "ͯ" and out and out[-1].isascii():
            continue
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def _letters(word: str) -> str:
    """Digits in a word of letters are what they look like."""
    return word.translate(DIGITS) if any(c.isalpha() for c in word) else word


def skeleton(text: str) -> str:
    """Letters that are taken for each other whatever the writing made equal."""
    return text.replace("i", "l")


def squeezed(text: str) -> str:
    return _REPEATED.sub(r"\1", text)


def misspelt(a: str, b: str, most: int) -> int:
    """The edits between two names; letters alike, "rn" for "m", "vv" for "w" and doubled letters count as none."""
    best = edits(skeleton(a), skeleton(b), most)
    if best and ("rn" in a or "rn" in b or "vv" in a or "vv" in b):
        best = min(best, edits(*(skeleton(x.replace("rn", "m").replace("vv", "w")) for x in (a, b)), most))
    if best > 1 and _REPEATED.search(a):
        best = min(best, edits(skeleton(squeezed(a)), skeleton(squeezed(b)), most))
    return best


def readings(value: str) -> list[str]:
    """The texts that a value may be read as."""
    text = html.unescape(html.unescape(value))
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).replace("_", " ")
    text = re.sub(r"\[\s*\d+\s*\]|[*†‡§]+|\(\s*\d+\s*\)", " ", text).strip().strip("\"'“”„«»‘’`").strip(" .,;:\t")
    parts = [p.strip(" \t.,;\"'-–—") for p in _PARTS.split(text)]
    return [p for p in dict.fromkeys(parts) if p]


def words_of(text: str) -> list[str]:
    """The words of a normalised text, "core, form" with the form moved to the front, initials joined."""
    if "," in text:
        head, _, tail = text.partition(",")
        if tail.strip(" .,"):
            text = f"{tail} {head}"
    text = _INITIALS.sub(lambda m: "".join(c for c in m.group() if c.isalpha()) + " ", text)
    return ["and" if w in ("&", "+") else _letters(w) for w in _WORDS.findall(text)]


def shortens(word: str, known: str) -> bool:
    """Whether ``word`` may be short for ``known``: its first letter and more of its letters in their order."""
    if not (len(word) < len(known) and len(known) > 2 and word[:1] == known[0]):
        return False
    at = iter(known)
    return all(c in at for c in word)


class Common:
    """The common words of a list, learned from counts over all its entries."""

    def __init__(self, n_entries: int, words: Counter) -> None:
        least = max(COMMON_LEAST, math.ceil(COMMON_SHARE * n_entries))
        self.n_entries = n_entries
        self.weight = {w: math.log(1 + n_entries / c) / math.log(1 + n_entries / least) for w, c in words.items() if c >= least}
        self.links: set[str] = set()
        self.initials: dict[str, set[tuple[str, ...]]] = defaultdict(set)
        self.kept = lru_cache(100_000)(self._meant)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.kept = lru_cache(100_000)(self._meant)

    def learn(self, facts: Counter) -> None:
        """Links and the initials of runs of common words, from ``second_facts``."""
        self.links = {w for w in self.weight if facts[("seen", w)] and facts[("seen", w)] == facts[("follows", w)]}
        for kind, run in facts:
            if kind == "run":
                for a in range(len(run)):
                    for b in range(a + 2, len(run) + 1):
                        self.initials["".join(w[0] for w in run[a:b])].add(run[a:b])

    def _meant(self, word: str) -> tuple[tuple[str, ...], ...]:
        """What common words ``word`` may stand for; none if it is a word of its own."""
        if word in self.weight:
            return ((word,),)
        if word in self.initials:
            return tuple(sorted(self.initials[word]))
        for known in self.weight:
            most = 0 if len(known) < 4 or len(word) < 4 else 1 if len(known) < 6 else 2
            if most and (edits(word, known, most) <= most or squeezed(word) == known):
                return ((known,),)
        short = [known for known in self.weight if shortens(word, known) and (len(word) < 5 or known.startswith(word))]
        starts = [known for known in short if known.startswith(word)]
        return tuple((known,) for known in sorted(starts or short))

    def little(self, word: str) -> str | None:
        """The common word of up to three letters, a link among them, that ``word`` is a misspelling of."""
        if not 0 < len(word) < 5:
            return None
        near = sorted((edits(word, k, 2), k not in self.links, k) for k in self.weight if len(k) < 4)
        return near[0][2] if near and near[0][0] <= (1 if len(word) < 4 and near[0][2] not in self.links or len(word) > 3 else 2) else None


class Reading:
    """One reading of a value: its core, its common words, each with what it may mean, and its whole name without blanks."""

    __slots__ = ("core", "forms", "joined")

    def __init__(self, text: str, common: Common) -> None:
        words = words_of(plain(text))
        self.joined = "".join(words)
        core: list[str] = []
        forms: list[tuple[tuple[str, ...], ...]] = []
        last = False  # whether the word before was a common one
        for n, word in enumerate(words):
            more = n + 1 < len(words)
            if word in ARTICLES and more and not core:
                continue
            meant = common.kept(word)
            if not meant and more and (near := common.little(word)) and (last or near not in common.links):
                meant = ((near,),)
            if not meant and more and common.kept(words[n + 1]) and all(m[-1] in common.links for m in common.kept(words[n + 1])) and n + 2 < len(words):
                meant = ((word,),)  # an unknown word before a link stands for a common one
            last = bool(meant)
            if meant:
                forms.append(meant)
            else:
                core.append(word)
        if not core:  # a name made of such words only
            core, forms = words, []
        self.core = "".join(core)
        self.forms = [f for f in forms if not all(m[-1] in common.links and len(m) == 1 for m in f)]

    def meant(self) -> set[str]:
        """The common words, each by its first meaning."""
        return {w for f in self.forms for w in f[0]}


def alike(reading: Reading, known: set[str], common: Common) -> float:
    """How far the common words of a value are those of an entry, from 0 to 1: the weight of the value's
    words that the entry has, and one more if the entry has no others. So which words an entry has
    beyond the value's makes no difference where two entries share a core, only whether it has any."""
    mine: set[str] = set()
    for meanings in reading.forms:
        mine |= set(max(meanings, key=lambda m: (len(known.intersection(m)), -len(m))))
    weigh = lambda words: sum(common.weight.get(w, 1.0) for w in words if w not in common.links)
    return (weigh(mine & known) + (not weigh(known - mine))) / (weigh(mine) + 1)


def _grams(text: str) -> set[str]:
    """Pairs of neighbouring letters, and of letters with one between."""
    padded = f"^{text}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)} | {f"{padded[i]}\n{padded[i + 2]}" for i in range(len(padded) - 2)}


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & ((1 << GRAM_BITS) - 1)


Entry = tuple[int, "str | None", "str | None", "str | None"]


def _names(rows: list[Entry]) -> list[tuple[int, str]]:
    return [(ident, text) for ident, name, _, local in rows for text in (name, local) if text and text.strip()]


def first_facts(rows: list[Entry]) -> Counter:
    """The entries, and those that hold each word."""
    found: Counter = Counter({("entries", ""): len(rows)})
    for _, name, _, local in rows:
        found.update({("word", w) for text in (name, local) if text for w in words_of(plain(text))})
    return found


def second_facts(rows: list[Entry], common: Common) -> Counter:
    """How often each common word is seen and follows another, the runs of common words, and the names
    that hold each n-gram bucket, as a core or as a whole."""
    found: Counter = Counter()
    for _, text in _names(rows):
        words, run = words_of(plain(text)), []
        for word in [*words, ""]:
            if word in common.weight:
                found[("seen", word)] += 1
                found[("follows", word)] += bool(run)
                run.append(word)
            else:
                if len(run) > 1:
                    found[("run", tuple(run))] += 1
                run = []
        reading = Reading(text, common)
        for part, name in enumerate((reading.core, reading.joined)):
            found.update({(part, _bucket(g)) for g in _grams(skeleton(name))})
        found[("names", "")] += 1
    return found


class Index:
    """The inverted index of a block of a reference list; ``common`` and ``facts`` are of the whole list."""

    def __init__(self, entries: list[Entry], common: Common | None = None, facts: Counter | None = None) -> None:
        if common is None or facts is None:
            first = first_facts(entries)
            common = Common(first[("entries", "")], Counter({w: c for (k, w), c in first.items() if k == "word"}))
            facts = second_facts(entries, common)
            common.learn(facts)
            facts = second_facts(entries, common)
        self.common = common
        self.codes: dict[str, set[int]] = defaultdict(set)
        for ident, _, code, _ in entries:
            if code and code.strip():
                self.codes[plain(code.strip())].add(ident)
        names = _names(entries)
        self.entry = [ident for ident, _ in names]
        self.reading = [Reading(text, common) for _, text in names]
        self.known = [r.meant() for r in self.reading]
        total = max(facts[("names", "")], 1)
        self.parts = []
        for part in range(2):
            counts = {b: c for (p, b), c in facts.items() if p == part and type(p) is int}
            written = [skeleton(r.joined if part else r.core) for r in self.reading]
            posting: dict[str, list[int]] = defaultdict(list)
            norm = np.zeros(len(written))
            weight = lambda g, c=counts: math.log(1 + total / c.get(_bucket(g), 1)) ** 2
            for n, name in enumerate(written):
                for gram in _grams(name):
                    posting[gram].append(n)
            weights = {g: weight(g) for g in posting}
            for gram, places in posting.items():
                norm[places] += weights[gram]
            self.parts.append(({g: np.asarray(p) for g, p in posting.items()}, weights, np.sqrt(norm), weight))

    def cosines(self, part: int, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(names, cosines) of the names of a part that share an n-gram with ``name`` and reach THRESHOLD."""
        posting, weights, norm, weight = self.parts[part]
        places, shares, own = [], [], 0.0
        for gram in _grams(skeleton(name)):
            held = posting.get(gram)
            if held is None:
                own += weight(gram)
                continue
            own += weights[gram]
            places.append(held)
            shares.append(np.full(len(held), weights[gram]))
        if not places:
            return np.zeros(0, int), np.zeros(0)
        found, at = np.unique(np.concatenate(places), return_inverse=True)
        cos = np.bincount(at, weights=np.concatenate(shares)) / (np.maximum(norm[found], 1e-9) * math.sqrt(own))
        near = cos >= THRESHOLD
        return found[near], cos[near]

    def best(self, value: str) -> list[tuple[float, int]]:
        """(score, entry) of the two best candidates that the exact check confirms, one per entry."""
        found: dict[int, float] = {}

        def put(n: int, score: float) -> None:
            found[self.entry[n]] = max(found.get(self.entry[n], -math.inf), score)

        for text in readings(value):
            for ident in self.codes.get(plain(text), ()):
                found[ident] = max(found.get(ident, 0.0), 1.0)
            reading = Reading(text, self.common)
            if not reading.core or not self.reading:
                continue
            hit = False
            for n, cos in zip(*self.cosines(0, reading.core)):
                most = allowed(len(skeleton(self.reading[n].core)))
                if (off := misspelt(reading.core, self.reading[n].core, most)) <= most:
                    hit = True
                    put(n, CORE_SHARE * float(cos) + (1 - CORE_SHARE) * alike(reading, self.known[n], self.common) - EDIT_COST * off)
            if not hit:  # blanks are missing, or a common word is beyond recognition
                for n, cos in zip(*self.cosines(1, reading.joined)):
                    joined = self.reading[n].joined
                    most = 0 if len(joined) < 10 or len(self.reading[n].core) < 6 else 2 if len(joined) < 20 else 3
                    if most and (off := misspelt(reading.joined, joined, most)) <= most:
                        put(n, float(cos) - EDIT_COST * off)
        return sorted(((s, i) for i, s in found.items()), key=lambda x: (-x[0], x[1]))[:2]


def _learn(entries: DataFrame, rows: list[Entry] | None) -> tuple[Common, Counter]:
    """The common words and the counts of the whole list: from ``rows`` if they are all of it, else by the
    same functions on the workers, whose counts are added up."""

    def over(facts, *more: object) -> Counter:  # noqa: ANN001
        if rows is not None:
            return facts(rows, *more)

        def work(batches: Iterator) -> Iterator:
            import pandas as pd

            for pdf in batches:
                held = [tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)]
                yield pd.DataFrame([(repr(k), c) for k, c in facts(held, *more).items()], columns=["fact", "n"])

        counted = entries.mapInPandas(work, "fact string, n long").groupBy("fact").agg(F.sum("n").alias("n"))
        if not more:  # only words that can be common are collected
            total = entries.count()
            counted = counted.filter((F.col("n") >= max(COMMON_LEAST, math.ceil(COMMON_SHARE * total))) | F.col("fact").contains("entries"))
        import ast

        return Counter({ast.literal_eval(r["fact"]): r["n"] for r in counted.collect()})

    first = over(first_facts)
    common = Common(first[("entries", "")], Counter({w: c for (k, w), c in first.items() if k == "word"}))
    common.learn(over(second_facts, common))
    return common, over(second_facts, common)  # links change what a core is


def match_values(values: DataFrame, entries: DataFrame, value: str = "value") -> DataFrame:
    """(value, entry, score): the entry (country_id) each distinct non-blank value means, 0 for none.

    ``entries`` has country_id, country, iso_code, local_name; nulls among the names are skipped. The
    list is taken in blocks of BLOCK_ENTRIES, one index each, and the blocks' best are compared; common
    words and weights are of the whole list, so the number of blocks changes no result. A task holds a
    block and counts of at most 2 * 2**GRAM_BITS buckets.
    """
    names = ["country_id", "country", "iso_code", "local_name"]
    distinct = values.select(value).filter(F.trim(value) != "").distinct()
    entries = entries.select(*names)
    n_blocks = max(1, math.ceil(entries.count() / BLOCK_ENTRIES))
    rows = [tuple(r) for r in entries.collect()] if n_blocks == 1 else None
    common, facts = _learn(entries, rows)
    parts = []
    for b in range(n_blocks):
        block = rows if rows is not None else [tuple(r) for r in entries.filter(F.pmod(F.xxhash64("country_id"), F.lit(n_blocks)) == b).collect()]

        def work(batches: Iterator, block: list = block) -> Iterator:
            import pandas as pd

            index = Index(block, common, facts)
            for pdf in batches:
                out = [(v, s, i) for v in pdf[value] for s, i in index.best(v)]
                yield pd.DataFrame(out, columns=[value, "score", "entry"])

        spread = distinct.repartition(shuffle_width(values.sparkSession))  # each task builds an index, so few values are worth a task
        parts.append(spread.mapInPandas(work, f"`{value}` string, score double, entry int"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy(value).orderBy(F.desc("score"), "entry")
    ranked = found.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).filter("n = 1")
    clear = F.col("next").isNull() | (F.col("score") - F.col("next") >= MARGIN)
    return ranked.select(value, F.when(clear, F.col("entry")).otherwise(F.lit(0)).alias("entry"), "score")


def map_countries(ranking: DataFrame, countries: DataFrame) -> DataFrame:
    """(ranking_id, country, country_id) of each row whose country is set, not merely blanks and not a
    countries.country as stored; country_id 0 if it means none."""
    rows = ranking.select("ranking_id", "country").filter(F.col("country").isNotNull() & (F.trim("country") != ""))
    rows = rows.join(countries.select("country").distinct(), "country", "left_anti")
    found = match_values(rows.select(F.col("country").alias("value")), countries)
    joined = rows.join(found, rows["country"] == found["value"], "left")
    return joined.select("ranking_id", "country", F.coalesce("entry", F.lit(0)).cast("int").alias("country_id"))
