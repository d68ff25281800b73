"""Evaluation passages that occur, whole or in part and outwardly changed, in documents.

Q-gram lemma filtering over normalised character streams, then banded alignment:

* A text becomes the stream of its letters, marks and digits: compatibility forms resolved, case and
  accents folded, everything else dropped, remarks in brackets taken out (those that could hold a
  passage are looked at by themselves). So spacing, punctuation, line breaks and hyphens at line ends
  make no difference.
* An item is cut into segments that overlap by more than any run that has to be found; its remarks in
  brackets, and its text with them, are segments too. So a segment is short whatever the item's length.
* Of each segment those character q-grams are indexed that few segments share. For every window of the
  least length that counts, with the greatest number of words altered, the number of indexed q-grams
  that must survive is bounded from below (the q-gram lemma, by words); grams that more segments share
  are added until the bound of each window is at least 4 or all are in. The least bound of a segment is
  its threshold. Where even all q-grams leave no bound, shorter q-grams are taken; only windows of
  which no SHORT letters in a row need survive, sixteen words of one letter, say, can be missed.
* A document's shared q-grams are counted per segment in overlapping bands of diagonals. Bands that
  reach the threshold within some window are aligned with the segment by banded local alignments over all diagonals of
  their hits, and accepted if some run is found with at most the allowed share of its words altered.

The items are indexed in blocks on the workers and the blocks kept in the shared folder. The documents
are read, normalised and turned into streams once; each task looks a stretch of them up in one block
after the other, so neither the driver nor a task holds more than one block.

Defined results: null, empty and other texts without a letter or digit match nothing; equal documents
and equal items count by themselves; an item shorter than the window counts if it is found whole.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamql.session import pinned_path

WORDS, LETTERS = 16, 40  # least run that counts, in scripts with and without blanks
ALTERED = 8  # at most one in so many words is altered
# what the alignment has to show: it may lose a word, or letters beyond an altered one, at an end
FOUND_WORDS, FOUND_LETTERS, FOUND_ALTERED = WORDS - 1, LETTERS - 4, ALTERED
Q_SPACED, Q_UNSPACED = 8, 5
BAND = {True: 64, False: 32}  # diagonals of a band, by whether words are spaced; the next begins half a band on
REACH = {True: 48, False: 24}  # diagonals to either side in the alignment, by whether words are spaced: words change length, letters hardly do
BATCH_CHARS = 3_000_000
HELD_BATCHES = 16  # batches of streams that a task holds while it looks them up in all blocks
BLOCK_ITEMS, BLOCK_CHARS = 4_000, 1_000_000  # items, and their characters, of one block of the index
SEGMENT = {True: (192, 48), False: (600, 120)}  # words or letters of a segment, and of its overlap with the next
LONG_REMARK = 2 * FOUND_WORDS - 1  # characters that a passage takes at least
SHORT = Q_UNSPACED

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 22
_BRACKETS = re.compile("[(\\[〔【)\\]〕】]|\\n\\s*\\n")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿豈-﫿฀-๿຀-໿]")
_LETTER = re.compile(r"[^\W_]")


class Folder:
    """Code points to codes of the stream, 0 for those that are dropped; looked up as they appear."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)
        self.table[0] = 1  # between texts

    def _code(self, point: int) -> int:
        ch = chr(point)
        kind = unicodedata.category(ch)
        if point == 0x0640:  # the Arabic stretching mark
            return 0
        if kind[0] == "L":
            if 0xAC00 <= point < 0xD7A4:
                return point
            return ord(unicodedata.normalize("NFD", ch.casefold())[0])
        if kind[0] == "M":
            return point if 0x0900 <= point < 0x1200 else 0
        if kind[0] == "N":
            digit = unicodedata.digit(ch, -1)
            return 48 + digit if digit >= 0 else point
        return 0

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[points]
        if (new := out < 0).any():
            for point in np.unique(points[new]):
                self.table[point] = self._code(int(point))
            out = self.table[points]
        return out


def without_remarks(text: str) -> list[str]:
    """``text`` (normalised to NFKC) without bracketed remarks, and the remarks that are long enough to
    hold a passage, without those within them. A bracket that isn't closed before the next blank line is
    an ordinary character."""
    kept: list[str] = []
    levels: list[list[str]] = [[]]
    at = 0
    for mark in _BRACKETS.finditer(text):
        ch = mark.group()
        levels[-1].append(text[at : mark.start()])
        at = mark.end()
        if ch in "([〔【":
            levels.append([ch])
        elif ch in ")]〕】":
            if len(levels) > 1:
                remark = "".join(levels.pop()[1:])
                if len(remark) >= LONG_REMARK:
                    kept.append(remark)
            else:
                levels[0].append(ch)
        else:
            for level in levels[1:]:
                levels[0] += level
            levels = levels[:1]
            levels[0].append(ch)
    for level in levels[1:]:
        levels[0] += level
    levels[0].append(text[at:])
    return ["".join(levels[0]), *kept]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-grams that begin at each place, for unspaced and spaced scripts."""
    wide = codes.astype(np.uint64)
    n = len(wide)
    h, short = wide, np.zeros(0, np.uint64)
    for k in range(1, Q_SPACED):
        if n - k <= 0:
            h = np.zeros(0, np.uint64)
            break
        h = h[: n - k] * _BASE + wide[k:]
        if k == Q_UNSPACED - 1:
            short = h
    mix = lambda x: (x ^ (x >> np.uint64(31))) * _MIX
    return mix(short), mix(h)


class Items:
    """The indexed segments of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        folder = Folder()
        self.ids, self.codes, self.words, self.spaced, self.need = [], [], [], [], []
        for ident, text in items:
            text = unicodedata.normalize("NFKC", (text or "").replace("\x00", " "))
            pieces = without_remarks(text)
            several = pieces[0] != text
            if several and not self._add(folder, ident, text, True):
                several = False  # too short for parts of it to count
                pieces = [text]
            for piece in pieces:
                self._add(folder, ident, piece, several)
        found = [grams(codes) for codes in self.codes]
        sets: list[dict[int, int]] = [{}, {}]
        for both in found:
            for held, hashes in zip(sets, both):
                for h in np.unique(hashes).tolist():
                    held[h] = held.get(h, 0) + 1
        entries: list[list[tuple[int, int, int]]] = [[], []]
        for n, both in enumerate(found):
            kind = int(self.spaced[n])
            need, chosen = self._choose(n, kind, both[kind].tolist(), sets[kind])
            if kind and need < 1:
                kind = 0
                need, chosen = self._choose(n, kind, both[kind].tolist(), sets[kind])
            self.need.append(max(need, 1))
            entries[kind] += [(int(both[kind][p]), n, int(p)) for p in np.flatnonzero(chosen)]
        self.index = []
        for rows in entries:
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.index.append((hashes, np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32), np.packbits(table)))

    def _add(self, folder: Folder, ident: int, text: str, long_only: bool) -> bool:
        """Add the segments of a text; False if there are none, or if it has to be long and isn't."""
        spaced = len(_UNSPACED.findall(text)) * 2 < max(1, len(_LETTER.findall(text)))
        pieces = [folder.codes(w) for w in (text.split() if spaced else [text])]
        pieces = [p[p > 0] for p in pieces]
        pieces = [p for p in pieces if len(p)]
        if not pieces or long_only and (len(pieces) < WORDS if spaced else len(pieces[0]) < LETTERS):
            return False
        codes = np.concatenate(pieces)
        word = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]) if spaced else np.arange(len(codes))
        size, overlap = SEGMENT[spaced]
        for begin in range(0, max(int(word[-1]) + 1 - overlap, 1), size - overlap):
            inside = (word >= begin) & (word < begin + size)
            self.ids.append(ident)
            self.codes.append(codes[inside])
            self.words.append(word[inside] - begin)
            self.spaced.append(spaced)
        return True

    def _choose(self, n: int, kind: int, hashes: list[int], counts: dict[int, int]) -> tuple[int, np.ndarray]:
        """The bound of a segment and its chosen q-grams, rare ones first."""
        if not hashes:
            return 0, np.zeros(0, bool)
        shared = np.array([counts[h] for h in hashes], np.int64)
        most = 1
        while True:
            chosen = shared <= most
            need = self._bound(n, chosen, Q_SPACED if kind else SHORT)
            if need >= 4 or most >= shared.max():
                return need, chosen
            most = min(most * 2, int(shared.max()))

    def _bound(self, n: int, chosen: np.ndarray, q: int) -> int:
        """The least number of chosen q-grams that survive in any window that counts."""
        word = self.words[n]
        n_words, size = int(word[-1]) + 1, WORDS if self.spaced[n] else LETTERS
        size = min(size, n_words)
        lost = max(1, size // ALTERED)
        places = np.flatnonzero(chosen)
        first, last = word[places], word[places + q - 1]
        least = 1 << 30
        for w in range(n_words - size + 1):
            inside = (first >= w) & (last < w + size)
            a, b = first[inside] - w, last[inside] - w
            touched = np.zeros(size + 1, np.int64)  # chosen grams that a word takes part in
            np.add.at(touched, a, 1)
            np.add.at(touched, b + 1, -1)
            touched = np.sort(np.cumsum(touched[:-1]))
            least = min(least, int(inside.sum()) - int(touched[-lost:].sum()))
        return least


def _align(items: np.ndarray, docs: np.ndarray, reach: int) -> np.ndarray:
    """The column of ``docs`` that each place of each item is matched with in the best banded local
    alignment, -1 where it isn't.

    Row r of ``items`` holds an item's codes, -1 behind its end; row r of ``docs`` the document's codes
    from the band's first diagonal on, as many as an item's row and 2 * ``reach`` more.
    """
    (n, m), width = items.shape, 2 * reach + 1
    rows = np.arange(n)
    score = np.zeros((n, width), np.int32)
    steps = np.zeros((m, n, width), np.uint8)
    drift = np.arange(width, dtype=np.int32)
    up = np.full((n, width), -1, np.int32)
    best, best_row, best_col = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(m):
        hit = docs[:, i : i + width] == items[:, i, None]
        np.subtract(score[:, 1:], 1, out=up[:, :-1])
        diag = score + hit
        diag += hit
        diag -= 1
        now = np.maximum(diag, up)
        step = np.where(diag >= up, 2 - hit, 3).astype(np.uint8)
        step *= now > 0
        np.maximum(now, 0, out=now)
        now += drift
        left = np.maximum.accumulate(now, axis=1)
        step[left > now] = 4
        left -= drift
        score = left
        steps[i] = step
        top = score.argmax(axis=1)
        value = score[rows, top]
        better = value > best
        best = np.where(better, value, best)
        best_row[better] = i
        best_col[better] = top[better]
    matched = np.full((n, m), -1, np.int32)
    i, j = best_row, best_col
    rows = np.flatnonzero(best > 0)
    while len(rows):
        step = steps[i[rows], rows, j[rows]]
        rows, step = rows[step > 0], step[step > 0]
        same = rows[step == 1]
        matched[same, i[same]] = i[same] + j[same]
        go = rows[step <= 2]
        i[go] -= 1
        go = rows[step == 3]
        i[go] -= 1
        j[go] += 1
        j[rows[step == 4]] -= 1
        rows = rows[(i[rows] >= 0) & (j[rows] >= 0) & (j[rows] < width)]
    return matched


def _long_run(good: np.ndarray, least: int) -> bool:
    """Whether a run of at least ``least`` has at most one in FOUND_ALTERED that isn't good."""
    n = len(good)
    least = min(least, n)
    bad = np.r_[0, np.cumsum(~good)]
    # the longest run that begins at a ends at the last b with bad[b] * k - b <= bad[a] * k - a
    value = bad * FOUND_ALTERED - np.arange(n + 1)
    ahead = np.minimum.accumulate(value[::-1])[::-1]
    return bool((ahead[least:] <= value[: n + 1 - least]).any())


def _whole_words(codes: np.ndarray, words: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words of an item the alignment holds whole.

    Beside an altered word an alignment may give letters of its neighbour away; so a word that isn't
    matched whole counts as whole if it stands, as it is, between the nearest words that are, or close
    to the only one.
    """
    sizes = np.bincount(words)
    good = np.bincount(words, weights=at >= 0) == sizes
    ends = np.cumsum(sizes)
    sure = np.flatnonzero(good)
    if not len(sure):
        return good
    for w in np.flatnonzero(~good):
        k = int(np.searchsorted(sure, w))
        low = int(at[ends[sure[k - 1]] - 1]) + 1 if k else 0
        high = int(at[ends[sure[k]] - sizes[sure[k]]]) if k < len(sure) else len(doc)
        if not k:
            low = max(low, high - int(sizes[w]) - REACH[True] // 2)
        elif k == len(sure):
            high = min(high, low + int(sizes[w]) + REACH[True] // 2)
        piece, word = doc[low:high].tolist(), codes[ends[w] - sizes[w] : ends[w]].tolist()
        if any(piece[x : x + len(word)] == word for x in range(len(piece) - len(word) + 1)):
            good[w] = True
    return good


@dataclass
class Streams:
    """The streams of a batch of texts, one after the other: ``codes`` with a 1 between pieces, the text
    each piece is of, and the bounds of the pieces in ``codes``."""

    codes: np.ndarray
    owner: np.ndarray
    bounds: np.ndarray


def streams(folder: Folder, texts: list[str]) -> Streams:
    cleaned = [without_remarks(t) for t in unicodedata.normalize("NFKC", "\x00".join(t.replace("\x00", " ") for t in texts)).split("\x00")]
    codes = folder.codes("\x00".join(p for pieces in cleaned for p in pieces))
    owner = np.repeat(np.arange(len(texts)), [len(pieces) for pieces in cleaned])
    codes = codes[codes > 0]
    return Streams(codes, owner, np.searchsorted(np.cumsum(codes == 1), np.arange(len(owner) + 1)))


class Finder:
    """Looks for one block of items in streams."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self.tables = [np.unpackbits(x[3]).view(bool) for x in items.index]

    def find(self, texts: list[str]) -> list[tuple[int, int]]:
        """(place in ``texts``, item id) pairs."""
        return self.search(streams(Folder(), texts))

    def search(self, streams: Streams) -> list[tuple[int, int]]:
        codes, owner, bounds = streams.codes, streams.owner, streams.bounds
        piece = np.cumsum(codes == 1)  # a separator belongs to the piece behind it
        keys = []
        for (hashes, item, place, _), table, h in zip(self.items.index, self.tables, grams(codes)):
            if not len(hashes) or not len(h):
                continue
            near = np.flatnonzero(table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            low = np.searchsorted(hashes, h[near], "left")
            count = np.searchsorted(hashes, h[near], "right") - low
            near, low, count = near[count > 0], low[count > 0], count[count > 0]
            if not len(near):
                continue
            at = np.repeat(near, count)
            entry = np.repeat(low, count) + (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count))
            keys.append((item[entry].astype(np.int64), at - place[entry], piece[at], place[entry].astype(np.int64)))
        if not keys:
            return []
        item, diagonal, where, place = (np.concatenate(x) for x in zip(*keys))
        need = np.array(self.items.need)
        asked: set[tuple[int, int, int]] = set()
        width = np.where(np.array(self.items.spaced)[item], BAND[True], BAND[False])
        for half in (0, 1):
            band = (diagonal + len(codes) + half * width // 2) // width
            order = np.lexsort((diagonal, band, where, item))
            a, b, c = item[order], band[order], where[order]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
            size = np.diff(np.r_[new, len(order)])
            for k in np.flatnonzero(size >= need[a[new]]):
                n, least = int(a[new[k]]), int(need[a[new[k]]])
                words = np.sort(self.items.words[n][place[order[new[k] : new[k] + size[k]]]])
                if not (words[least - 1 :] - words[: len(words) - least + 1] < (WORDS if self.items.spaced[n] else LETTERS)).any():
                    continue  # nowhere as many in a window as must survive in it
                lowest, highest = int(diagonal[order[new[k]]]), int(diagonal[order[new[k] + size[k] - 1]])
                reach = REACH[self.items.spaced[int(a[new[k]])]]
                parts = 1 + (highest - lowest) // (3 * reach // 2)  # alignments that together cover all hits, with room to drift
                for x in range(parts):
                    asked.add((int(a[new[k]]), int(c[new[k]]), lowest + (2 * x + 1) * (highest - lowest) // (2 * parts)))
        pairs: set[tuple[int, int]] = set()
        # both bandings find most regions; one alignment will do for centres this close
        lots: list[tuple[int, int, int]] = []
        for n, p, d in sorted(asked):
            if not (lots and lots[-1][:2] == (n, p) and d - lots[-1][2] <= REACH[self.items.spaced[n]] // 6):
                lots.append((n, p, d))
        for spaced, reach in REACH.items():
            own_lots = sorted((x for x in lots if self.items.spaced[x[0]] == spaced), key=lambda x: len(self.items.codes[x[0]]))
            for lot in range(0, len(own_lots), 96):
                self._judge(own_lots[lot : lot + 96], reach, codes, bounds, owner, pairs)
        return sorted(pairs)

    def _judge(self, part: list[tuple[int, int, int]], reach: int, codes: np.ndarray, bounds: np.ndarray, owner: np.ndarray, pairs: set[tuple[int, int]]) -> None:
        """Align candidates (item, piece, diagonal) of one class and add those that hold a passage."""
        longest = max(len(self.items.codes[n]) for n, _, _ in part)
        span = longest + 2 * reach
        own, rows = np.full((len(part), longest), -1, np.int32), np.zeros((len(part), span), np.int32)
        for r, (n, p, d) in enumerate(part):
            own[r, : len(self.items.codes[n])] = self.items.codes[n]
            lo, hi = max(d - reach, int(bounds[p]), 0), min(d - reach + span, int(bounds[p + 1]))
            if hi > lo:
                rows[r, lo - (d - reach) : hi - (d - reach)] = codes[lo:hi]
        matched = _align(own, rows, reach)
        for r, (n, p, _) in enumerate(part):
            at = matched[r, : len(self.items.codes[n])]
            if self.items.spaced[n]:
                ok = _long_run(_whole_words(self.items.codes[n], self.items.words[n], at, rows[r]), FOUND_WORDS)
            else:
                ok = _long_run(at >= 0, FOUND_LETTERS)
            if ok:
                pairs.add((int(owner[p]), self.items.ids[n]))


def index_blocks(items: DataFrame) -> tuple[str, int]:
    """Where the index of ``items`` (item_id, text) is, one Parquet folder per block, and the blocks.

    Rows of one item_id and text count once; blocks are of about BLOCK_ITEMS items or BLOCK_CHARS characters.
    """
    once = items.select("item_id", "text").distinct()
    size = once.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n_blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))

    def build(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = sorted((int(i), t) for i, t in zip(pdf["item_id"], pdf["text"]) if t)
        return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "payload": [pickle.dumps(Items(rows), protocol=5)]})

    numbered = once.filter(F.col("item_id").isNotNull()).withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int"))
    return pinned_path(numbered.groupBy("block").applyInPandas(build, "block int, payload binary"), ["block"]), n_blocks


_held: dict[str, Finder] = {}  # the block that this worker used last


def _finder(path: str, block: int) -> Finder | None:
    """The finder of a block, read from the shared folder; None if no item fell into it."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    name = f"{path}/block={block}"
    if name not in _held:
        store, folder = fs.FileSystem.from_uri(name)
        files = [] if store.get_file_info(folder).type == fs.FileType.NotFound else store.get_file_info(fs.FileSelector(folder))
        payloads = [p for f in files if f.path.endswith(".parquet") for p in pq.read_table(f.path, filesystem=store, columns=["payload"], partitioning=None).column(0).to_pylist()]
        _held.clear()
        _held[name] = Finder(pickle.loads(payloads[0])) if payloads else None  # noqa: S301 - written by index_blocks
    return _held[name]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each document and item of which the document holds a passage.

    The items are the query set, indexed by ``index_blocks``; the documents are read once, whatever the
    number of items, and none leaves its task.
    """
    path, n_blocks = index_blocks(items)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        folder = Folder()
        held: list[tuple[list, Streams]] = []

        def look() -> pa.RecordBatch:
            found: list[set[tuple[int, int]]] = [set() for _ in held]  # an item's texts may be in several blocks
            for block in range(n_blocks):
                if finder := _finder(path, block):
                    for pairs, (_, made) in zip(found, held):
                        pairs.update(finder.search(made))
            out = [(ids[p], item) for pairs, (ids, _) in zip(found, held) for p, item in sorted(pairs)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["doc_id", "item_id"])

        ids, lot, size = [], [], 0
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                ids.append(ident)
                lot.append(text)
                size += len(text)
                if size > BATCH_CHARS:
                    held.append((ids, streams(folder, lot)))
                    ids, lot, size = [], [], 0
                    if len(held) >= (HELD_BATCHES if n_blocks > 1 else 1):
                        yield look()
        if lot:
            held.append((ids, streams(folder, lot)))
        if held:
            yield look()

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, item_id bigint")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_documents) of every item, 0 where no document holds it."""
    counts = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"))
