"""Sentence units with their places, across languages and scripts.

A pushdown automaton walks over the marks of a paragraph. One stack holds the open quotations and
brackets, so nothing ends inside them; another holds the levels of lists: the kind and number of the
marker that each level is at. Its state is where the unit began and how the outermost quotation was
introduced. Marks that could end a sentence are settled by script, by a trie of abbreviations and by
what follows.

A list marker (``1.``, ``2)``, ``(3)``, ``1.1.``, ``a)``, ``(b)``, ``iv.``, a bullet) counts at the head of
a paragraph, and at the head of a line where it goes on with a level of the stack, or begins a level
behind a colon, a semicolon or within a list. It belongs to its item, and an item begins a unit.

Defined results: a null, empty or blank text has no unit; an opening mark whose partner is missing
before the next blank line is an ordinary character; offsets are code points. Time grows with the
text's length only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

# Abbreviations, without their last dot, lower case. Those of the first set never end a
# sentence; those of the second may, when a capital follows.
BOUND = """
mr mrs ms messrs dr prof rev hon gen col capt lt sgt st mt ft vol vols p pp no nos art arts para paras sec secs ch fig figs approx
ca cf vs viz e.g eg i.e ie ed eds dept univ jan feb mar apr jun jul aug sept sep oct nov dec
hr fr frl abg abs nr bd bzw vgl sog evtl ggf inkl mio mrd tsd str d.h z.b z.t u.a i.d.r d z i u bes hrsg geb gest kap ziff anm
m mm mme mmes mlle mlles me mgr al t env av apr chap éd n° num vol
ст п пп ч гл стр с ок млн млрд тыс деп гр см ср напр проф акад т.е д-р г-н г-жа им ул пер обл р руб коп табл рис зам
डॉ श्री सुश्री प्रो पं स्व कु
د م أ ص ج ت ق هـ
ดร ศ ผศ รศ ม พ.ศ ค.ศ น.ส
""".split()
# abbreviations only before a number, else words that may end a sentence
NUMBERED = set("no nos art arts para paras sec secs fig figs ch vol vols mar dec jan sept ed eds ms gen rev sog hon is p pp n n°".split())
LOOSE = "etc usw ff f suiv a.m p.m jr sr inc ltd co corp bros u.s.w т.д т.п др пр г гг в вв н.э usf".split()

TERMINATORS = ".!?…。！？｡．।॥؟۔"
DOTTED = ".…．"
OPENERS = {"(": ")", "[": "]", "（": "）", "［": "］", "〔": "〕", "【": "】", "{": "}", "「": "」", "『": "』", "«": "»", "‹": "›", "《": "》", "〈": "〉", "„": "“”", "“": "”"}
BRACKETS = "([（［〔【{"
BRACKET_ENDS = {OPENERS[b]: b for b in BRACKETS}
TITLES = "《〈"
CLOSERS = {c for cs in OPENERS.values() for c in cs} | {'"'}
CONTINUERS = ",;:،؛、，；：—–-‐‑/&%"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
ORDINAL_AFTER = {"am", "zur", "zum", "der", "die", "das", "dem", "den", "des", "vom", "im", "beim", "ab", "seit", "dritter"}
# small words of a speaker's title, and verbs that introduce speech instead
TITLE_WORDS = set("the la le les l de des du d von van der die das den of and et und y président présidente president chair chairman chairwoman speaker secretary vice herr frau г г-н г-жа д-р и".split())
SPEECH = re.compile("(?:说|道|问|称|写着|写道|表示|言う|述べた|कहा|पूछा|กล่าวว่า|ถามว่า|เขียนว่า)$|^(?:قال|قالت|سأل|سألت|كتب|أجاب|أضاف)(?!\\w)")
PARTICLES = "とってっ"  # after a quotation these carry the sentence on

_BLANK_LINE = re.compile("(?:\r\n|\n|\r)[^\\S\r\n]*(?:\r\n|\n|\r)\\s*|\u2029\\s*")
_MARKS = re.compile(r"[.…．]+|[!?。！？｡।॥؟۔]|[\"()\[\]{}（）［］〔〕【】「」『』«»‹›《》〈〉„“”]")
_THAI_MARKS = re.compile(_MARKS.pattern + r"|\s+")
_THAI = re.compile("[ก-๎]")
_LETTER = re.compile(r"[^\W\d_]")
_NOT_IN_WORD = set(".…\"“”„«»()[]（）「」,;:!?")
# the number, letter or Roman number of a list marker, by the marker's kind
_MARKER = re.compile(
    r"(?:\((?P<digits_in>\d{1,3})\)|\((?P<roman_in>[ivx]+)\)|\((?P<letter_in>[a-z])\)|(?P<level>(?:\d{1,3}\.)+\d{1,3})[.)]|(?P<digits_dot>\d{1,3})\.|(?P<digits_end>\d{1,3})\)"
    r"|(?P<roman_dot>[ivx]+)\.|(?P<roman_end>[ivx]+)\)|(?P<letter_dot>[a-z])\.|(?P<letter_end>[a-z])\)|(?P<bullet>[•‣▪◦]))(?=\s+\S)"
)
_LINE_HEAD = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?=[\d(a-z•‣▪◦])")
_FIRST = {"1", "1.1", "a", "i", "•", "‣", "▪", "◦"}
_ROMAN = {"i": 1, "v": 5, "x": 10}
_LABEL = re.compile(r"(?:[^\n\r:：\d!?。！？।؟“”„«»「」\"]|(?:\r\n|\n|\r)(?![^\S\r\n]*[\r\n]))+[:：]")
_QUOTES = "\"“„«「『‹"


class Trie:
    """Abbreviations by their letters from the last to the first, matched up to a word's edge."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for ch in reversed(word):
                node = node.setdefault(ch, {})
            node["$"] = True

    def ends_at(self, text: str, end: int, floor: int = 0) -> int:
        """The start of the longest abbreviation that ends before ``end`` and begins at or behind
        ``floor``, blanks after inner dots allowed, or -1."""
        node, at, found = self.root, end, -1
        while at > floor:
            ch = text[at - 1].lower()
            if ch not in node:
                # "т. д." is "т.д." with a blank
                if ch.isspace() and "." in node and at > floor + 1 and text[at - 2] == ".":
                    at -= 1
                    continue
                break
            node = node[ch]
            at -= 1
            if "$" in node and (at == floor or not (text[at - 1].isalnum() or text[at - 1] in ".-" or text[at - 1] in INVISIBLE)):
                found = at
        return found


_BOUND, _LOOSE = Trie(BOUND), Trie(LOOSE)


def _next_place(text: str, at: int, end: int) -> int:
    while at < end and (text[at].isspace() or text[at] in INVISIBLE):
        at += 1
    return at


def _past_brackets(text: str, at: int, end: int) -> int:
    """The place of the next character that isn't in a bracketed remark."""
    at = _next_place(text, at, end)
    while at < end and text[at] in BRACKETS:
        close = text.find(OPENERS[text[at]], at, end)
        if close < 0:
            break
        at = _next_place(text, close + 1, end)
    return at


def _before_brackets(text: str, at: int, start: int, opened: dict[int, int]) -> int:
    """The end of the last word before ``at`` that isn't in a bracketed remark; ``opened`` has the place
    where each bracket that was closed had been opened."""
    while at > start:
        if text[at - 1].isspace() or text[at - 1] in INVISIBLE:
            at -= 1
        elif opened.get(at - 1, -1) >= start:
            at = opened[at - 1]
        else:
            return at
    return at


def _word_before(text: str, at: int, start: int) -> str:
    """The word that ends at ``at`` and begins at or behind ``start``."""
    begin = at
    while begin > start and not (text[begin - 1].isspace() or text[begin - 1] in _NOT_IN_WORD):
        begin -= 1
    return text[begin:at]


def _dot_ends(text: str, dot: int, after: int, end: int, start: int, opened: dict[int, int]) -> bool:
    """Whether the single dot at ``dot`` ends the sentence; ``after`` is the place behind it and any
    closing marks."""
    place = _next_place(text, after, end)
    spaced = place > after
    if place >= end:
        return True
    nxt = text[place]
    if nxt in CONTINUERS:
        return False
    word = _word_before(text, dot, start)
    if not word:
        if dot > start and text[dot - 1] in CLOSERS:
            return not nxt.islower()
        return spaced and not nxt.islower()
    digits = word.strip("()").isdigit()
    if not spaced and after == dot + 1:
        if nxt.isdigit() and (word[-1].isdigit() or len(word) == 1):
            return False
        if nxt.isalpha():
            inner = dot - len(word) > 0 and text[dot - len(word) - 1] == "."
            if len(word) == 1 and not digits and (inner or word.isalpha()):
                return False
    if nxt.islower():
        return False
    if digits:
        if dot - len(word) <= start:  # a list item's number
            return False
        if len(word) <= 3:
            if _word_before(text, _before_brackets(text, dot - len(word), start, opened), start).lower() in ORDINAL_AFTER:
                return False
        return True
    loose = _LOOSE.ends_at(text, dot, start)
    if loose < 0 and word in ("д", "п"):  # a remark may stand within "т. д."
        behind = _before_brackets(text, dot - 1, start, opened)
        if text[behind - 2 : behind] == "т.":
            loose = behind - 2
    if loose >= 0:
        ahead = _past_brackets(text, after, end)
        if ahead < end and text[ahead].islower():
            return False
        number = loose
        while number > start and text[number - 1].isspace():
            number -= 1
        if word in ("г", "в", "f") and not (number > start and text[number - 1].isdigit()):
            return False
        return not nxt.isdigit()
    if _BOUND.ends_at(text, dot, start) >= 0:
        ahead = _past_brackets(text, after, end)
        return word in NUMBERED and not (ahead < end and text[ahead].isdigit())
    if len(word) == 1 and word.isalpha():  # an initial
        return False
    if len(word) == 1 and dot - 2 >= start and text[dot - 2] == ".":
        return False
    if "ऀ" <= word[-1] <= "ॿ":  # Devanagari sentences end in a danda
        return False
    return True


def _mark_ends(text: str, after: int, end: int) -> bool:
    """Whether ? or ! and the like end the sentence, seen from what follows."""
    place = _next_place(text, after, end)
    if place >= end:
        return True
    nxt = text[place]
    return not (nxt.islower() or nxt in ",;،؛、，；—–")


def _quote_ends(text: str, after: int, end: int, first: bool, colon: bool) -> bool:
    """Whether a sentence ends with the quotation that was just closed and ended in an end mark.

    ``first``: the quotation began the unit; ``colon``: a colon introduced it.
    """
    place = _next_place(text, after, end)
    if place >= end:
        return True
    if text[place] in CONTINUERS or text[place] in TERMINATORS:
        return False
    ahead = _past_brackets(text, after, end)
    if ahead >= end:
        return True
    nxt = text[ahead]
    if nxt.islower() or nxt in CONTINUERS:
        return False
    if nxt.isalpha() and not nxt.isupper():  # a script without case
        return colon and nxt not in PARTICLES
    return True


def _label_end(text: str) -> int:
    """The end of a speaker's label at the head of the text, or 0."""
    start = _next_place(text, 0, len(text))
    found = _LABEL.match(text, start)
    if not found:
        return 0
    head = found.group()[:-1].rstrip()
    if not _LETTER.search(head) or sum(head.count(b) for b in BRACKETS) != sum(head.count(b) for b in ")]）］〕】}"):
        return 0
    for dot in re.finditer(r"[.…]+", head):
        at = start + dot.start()
        if len(dot.group()) > 1 or _BOUND.ends_at(text, at, start) < 0 and not (at - 1 >= start and text[at - 1].isalpha() and (at - 2 < start or not text[at - 2].isalnum())):
            return 0
    # words that a name or office would not have: none without a party or office behind it, else fewer than the others
    words = re.findall(r"[^\W\d_]{2,}", head)
    small = [w for w in words if w[0].islower() and w not in TITLE_WORDS]
    if head[-1] in ")]）］":
        if 2 * len(small) > max(len(words), 6):
            return 0
    elif small or SPEECH.search(head):
        return 0
    return found.end()


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of each unit of ``text``."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    at = _label_end(text)
    if at:
        out.append((_next_place_space(text, 0, at), at))
    thai = len(_THAI.findall(text)) * 2 > len(_LETTER.findall(text)) if _THAI.search(text) else False
    marks = _THAI_MARKS if thai else _MARKS
    for gap in [*_BLANK_LINE.finditer(text, at), None]:
        end = gap.start() if gap else len(text)
        if end > at:
            _paragraph(text, at, end, marks, thai, out)
        at = gap.end() if gap else end
    return out


def _next_place_space(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


class Levels:
    """The stack of list levels: the kind of marker of each and the number it is at."""

    def __init__(self) -> None:
        self.held: list[tuple[str, tuple[int, ...]]] = []

    def take(self, found: re.Match, anywhere: bool) -> bool:
        """Whether the marker goes on with a level, which ends those within it, or begins one. A level
        begins with the first number, ``anywhere`` with any."""
        readings = self._readings(found)
        at = {kind: n for n, (kind, _) in enumerate(self.held)}  # a kind has one level at most
        for kind, numbers in readings:
            if kind in at and numbers in self._next(self.held[at[kind]][1]):
                self.held[at[kind] :] = [(kind, numbers)]
                return True
        for kind, numbers in readings:
            if anywhere or self.held and kind not in at and numbers[-1] == 1:
                self.held[at.get(kind, len(self.held)) :] = [(kind, numbers)]
                return True
        return False

    @staticmethod
    def _next(was: tuple[int, ...]) -> set[tuple[int, ...]]:
        """What may follow a number: 1.2 is followed by 1.3, 2, 2.1 and 1.2.1; 1 by 1 where none counts up."""
        return {(1,) if was == (1,) else (was[0] + 1,)} | {(*was[:n], was[n] + 1) for n in range(len(was))} | {(*was[:n], was[n] + 1, 1) for n in range(len(was))} | {(*was, 1)}

    @staticmethod
    def _readings(found: re.Match) -> list[tuple[str, tuple[int, ...]]]:
        kind, text = found.lastgroup, found.group(found.lastgroup)
        if kind == "bullet":
            return [(kind, (1,))]
        form, _, place = kind.partition("_")
        if form == "level":
            return [("digits_dot", tuple(int(x) for x in text.split(".")))]
        if form == "digits":
            return [(kind, (int(text),))]
        letter = [(f"letter_{place}", (ord(text) - 96,))] if len(text) == 1 else []
        if form == "letter":
            return letter
        values = [_ROMAN[c] for c in text]
        total = sum(-v if v < max(values[n:]) else v for n, v in enumerate(values))
        return [*letter, (kind, (total,))] if text != "i" else [(kind, (1,)), *letter]


def _paragraph(text: str, at: int, end: int, marks: re.Pattern, thai: bool, out: list[tuple[int, int]]) -> None:
    start = _next_place_space(text, at, end)
    while end > start and text[end - 1].isspace():
        end -= 1
    stack: list[tuple[str, int]] = []  # closing marks that are awaited, and where they were opened
    opened: dict[int, int] = {}  # of each bracket that was closed, where it had been opened
    last: dict[str, int] = {}  # the last place of a closing mark

    def awaits(partners: str, place: int) -> bool:
        """Whether one of ``partners`` comes behind ``place``."""
        for p in partners:
            if p not in last:
                last[p] = text.rfind(p, at, end)
        return any(last[p] > place for p in partners)

    levels = Levels()
    skip = start
    if marker := _MARKER.match(text, start, end):
        levels.take(marker, True)
        skip = marker.end()
    remark = first = colon = False
    heads = iter(_LINE_HEAD.finditer(text, start, end))
    head = next(heads, None)

    def lines(upto: int) -> None:
        """End the unit at list markers at the heads of the lines that begin before ``upto``."""
        nonlocal head, start, skip, first, colon
        while head and head.end() <= upto:
            if head.start() >= skip and not stack and (marker := _MARKER.match(text, head.end(), end)):
                before = head.start()
                while before > start and text[before - 1].isspace():
                    before -= 1
                begins = before > start and text[before - 1] in ":;：；" and marker.group(marker.lastgroup) in _FIRST
                if levels.take(marker, begins):
                    if before > start:
                        out.append((start, before))
                    start, skip = marker.start(), marker.end()
                    first = colon = False
            head = next(heads, None)

    for mark in marks.finditer(text, start, end):
        place = mark.start()
        lines(place)
        if place < skip:
            continue
        ch = text[place]
        stop = -1
        if stack and ch in stack[-1][0]:
            opened[place] = stack.pop()[1]
            if stack:
                continue
            after = place + 1
            if remark:
                remark = False
                stop = after
            elif ch in ")]）］〕】}》〉":
                continue
            else:
                inside = place - 1
                while inside > start and (text[inside].isspace() or text[inside] in CLOSERS or text[inside] in INVISIBLE):
                    inside -= 1
                if text[inside] in TERMINATORS and not thai and _quote_ends(text, after, end, first, colon):
                    stop = after
        elif stack:
            if ch in OPENERS and awaits(OPENERS[ch][0], place - 1):
                stack.append((OPENERS[ch], place))
            continue
        elif ch in OPENERS or ch == '"':
            partners = OPENERS.get(ch, '"')
            if not awaits(partners, place):
                continue
            stack.append((partners, place))
            begins = _next_place(text, start, place) == place
            if ch in BRACKETS:
                remark = begins
            elif ch not in TITLES:
                first = begins
                back = _before_brackets(text, place, start, opened)
                colon = not begins and text[back - 1 : back] in (":", "：")
            continue
        elif ch in CLOSERS:
            continue
        elif ch.isspace():  # Thai: blanks end units
            before, behind = text[place - 1], text[mark.end()] if mark.end() < end else ""
            if "\n" in mark.group() or "\r" in mark.group():
                continue
            if before.isdigit() or behind.isdigit() or before == "ๆ" or before in "\"”»’" or behind in "\"“«‘":
                continue
            stop = place
        else:
            after = mark.end()
            run = mark.group()
            if ch not in DOTTED:
                while after < end and text[after] in "!?！？.…。":
                    after += 1
            while after < end and text[after] in CLOSERS and text[after] != '"' and text[after] not in OPENERS:
                after += 1
            if ch in DOTTED:
                if ch == "." and len(run) == 1:
                    done = not thai and _dot_ends(text, place, after, end, start, opened)
                else:
                    ahead = _next_place(text, after, end)
                    done = ahead >= end or text[ahead].isupper() or text[ahead] in _QUOTES and not stack
                    done = done and ahead > after or ahead >= end
            else:
                done = _mark_ends(text, after, end)
            if not done:
                continue
            stop = after
        if stop < 0:
            continue
        if stop > start:
            out.append((start, stop))
        start = _next_place_space(text, stop, end)
        skip = stop
        first = colon = False
    lines(end)
    if start < end:
        out.append((start, end))


def sentence_units(documents: DataFrame, text: str = "text", identity: str = "doc_id") -> DataFrame:
    """(identity, start_char, end_char) of every unit of every document."""
    kind = documents.schema[identity].dataType.simpleString()

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            rows, starts, ends = [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                if value:
                    for a, b in units(value):
                        rows.append(k)
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[identity, "start_char", "end_char"])

    return documents.select(identity, text).mapInArrow(split, f"`{identity}` {kind}, start_char int, end_char int")
