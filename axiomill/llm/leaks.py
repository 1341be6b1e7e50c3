"""Problem 8: evaluation texts leaking into training text.

The normalised words of all test items form one generalised suffix automaton. The
words of every document stream through it; it keeps the longest suffix of what it
has read that stands in some item. Its shorter suffixes may stand in further items,
so wherever a place in an item ceases to match, though others go on, the suffix that
reached it is a seed with all the places where it occurs. Seeds are extended both ways
over small slips; a row of matched words that is long enough, or that covers
enough of an item, is a leak, and its span can be removed from the text.

The items are the stated query set: they are few and fixed, and are sent to all
tasks in blocks of bounded size. Documents are read once a block, never exchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12  # words of an item in a row that make a leak
SEED = 3  # words without a slip that start or resume a row
BLOCK_WORDS = 200_000  # words of items in one automaton; more items take more blocks
Taken = tuple[bytearray, bytearray] | None
SPANS = "doc_id bigint, item_id bigint, first_char bigint, end_char bigint, n_words int, coverage double"

NUMERAL = re.compile(r"[(\[{]\s*\d{1,5}[a-z]?'?\s*[)\]}]")
HYPHENS = "­‐‑"
BROKEN = re.compile(rf"(?<=\w)[-{HYPHENS}][ \t]*\r?\n\s*(?=\w)|­")
NOT_WORD = re.compile(r"[^\w\s]|_")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, bracketed numerals and hyphens at line ends; what a blank parts is a word."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = NUMERAL.sub(" ", text.lower())
    if "-" in text or not text.isascii():
        text = BROKEN.sub("", text)
    return NOT_WORD.sub("", text).split()


def places(text: str) -> list[tuple[int, int]]:
    """For each of ``words_of(text)``, where it begins and ends in the text as it came."""
    chars, at = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).lower() if not c.isascii() else c.lower():
            chars.append(x)
            at.append(i)
    flat = "".join(chars)
    gone = bytearray(len(flat))
    for m in NUMERAL.finditer(flat):
        gone[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    for m in BROKEN.finditer(flat):
        gone[m.start() : m.end()] = b"\x02" * (m.end() - m.start())
    out, open_at, last = [], None, 0
    for i, c in enumerate(flat):
        if gone[i] == 2:
            continue
        if gone[i] == 1 or c.isspace():
            if open_at is not None:
                out.append((open_at, last + 1))
                open_at = None
        elif not NOT_WORD.match(c):
            open_at = at[i] if open_at is None else open_at
            last = at[i]
    if open_at is not None:
        out.append((open_at, last + 1))
    return out


class Automaton:
    """Generalised suffix automaton of sequences of word numbers, with the ends of each state's strings."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items
        self.number: dict[str, int] = {}
        self.seqs = []
        for _, ws in items:
            self.seqs.append([self.number.setdefault(w, len(self.number) + 1) for w in ws])
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(self.seqs):
            last = 0
            for pos, c in enumerate(seq):
                last = self._extend(last, c, own)
                own[last].append((k, pos))
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True)
        self.ends = own
        for v in order:  # a state also ends wherever a longer string with it as suffix does
            if self.link[v] > 0:
                self.ends[self.link[v]] = self.ends[self.link[v]] + self.ends[v]
        self.count = [len(e) for e in self.ends]
        n = len(self.number) + 1
        pairs = {a * n + b for s in self.seqs for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, c: int, own: list) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, q, c, own)
        cur = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        own.append([])
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, q, c, own)
        return cur

    def _clone(self, p: int, q: int, c: int, own: list) -> int:
        nxt, link, size = self.next, self.link, self.size
        new = len(size)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        own.append([])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def seeds(self, nums: np.ndarray) -> list[tuple[int, int, int]]:
        """(state, end, length) of every match of SEED words or more that the next word ends in a place where no longer one ends."""
        if len(nums) < SEED:
            return []
        n = len(self.number) + 1
        code = nums[:-1] * n + nums[1:]
        at = np.searchsorted(self.pairs, code)
        ok = (self.pairs[np.minimum(at, len(self.pairs) - 1)] == code) & (nums[:-1] > 0) & (nums[1:] > 0) if len(self.pairs) else np.zeros(len(code), bool)
        # where two words stand in no item side by side, no match goes on: walk only what lies between
        edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        keep = end - begin >= SEED
        out = []
        nxt, link, size, count = self.next, self.link, self.size, self.count

        def ended(v: int, at: int, n: int, c: int) -> None:
            lost = 0  # places that end here with the suffixes looked at so far
            while n >= SEED:
                to = nxt[v].get(c)
                gone = count[v] - (count[to] if to is not None else 0)
                if gone > lost:
                    out.append((v, at, n))
                    lost = gone
                v = link[v]
                n = size[v]

        for a, b in zip(begin[keep].tolist(), end[keep].tolist()):
            state = length = 0
            for i, c in enumerate(nums[a:b].tolist(), a):
                if length >= SEED:
                    ended(state, i, length, c)
                while state and c not in nxt[state]:
                    state = link[state]
                    length = size[state]
                state = nxt[state].get(c, 0)
                length = length + 1 if state else 0
            if length >= SEED:
                ended(state, b, length, 0)
        return out


def near(a: str, b: str) -> bool:
    """The same word but for a letter wrong, missing, added or swapped; two in a long word."""
    if a == b:
        return True
    short, long_ = sorted((len(a), len(b)))
    most = 0 if short < 4 else 1 if short < 8 else 2
    if long_ - short > most or a.isdigit() or b.isdigit():
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def _run(doc: list[str], item: list[str], i: int, j: int, step: int, most: int = 10**9) -> tuple[int, int, int]:
    """Matched words from doc[i], item[j] on, with the places after them; two words may be written as one."""
    n = 0
    while n < most and 0 <= i < len(doc) and 0 <= j < len(item):
        if near(doc[i], item[j]):
            i, j, n = i + step, j + step, n + 1
            continue
        two = lambda s, k: s[k] + s[k + 1] if step > 0 else s[k - 1] + s[k]
        if 0 <= j + step < len(item) and len(doc[i]) > 3 and doc[i] == two(item, j):
            i, j, n = i + step, j + 2 * step, n + 2
        elif 0 <= i + step < len(doc) and len(item[j]) > 3 and item[j] == two(doc, i):
            i, j, n = i + 2 * step, j + step, n + 1
        else:
            break
    return n, i, j


def _extend_row(doc: list[str], item: list[str], i: int, j: int, step: int, taken: Taken = None) -> list[tuple[int, int]]:
    """(matched words, place after them in doc) of pieces parted by one slip each, from doc[i], item[j] on."""
    out = []
    n, i, j = _run(doc, item, i, j, step)
    out.append((n, i))
    while True:
        best = None
        for di, dj in ((1, 1), (1, 0), (0, 1)):  # a word wrong, added, missing
            if taken and 0 <= i < len(doc) and taken[not di][i if di or step > 0 else i + 1]:
                continue
            m, a, b = _run(doc, item, i + di * step, j + dj * step, step)
            if m >= SEED and (best is None or m > best[0]):
                best = (m, a, b)
        if best is None:
            return out
        n, i, j = best
        out.append((n, i))


def rows_of_words(doc: list[str], item: list[str], end: int, pos: int, length: int, taken: Taken = None) -> tuple[int, int, int] | None:
    """The longest row around a seed that has few enough slips: (words, first, after last), or None.

    Slips part pieces of SEED words or more, and are at most one to five matched words.
    ``taken`` marks words, and bounds before words, that cannot be slips.
    """
    left = _extend_row(doc, item, end - length - 1, pos - length, -1, taken)
    right = _extend_row(doc, item, end, pos + 1, 1, taken)
    pieces = [(n, a) for n, a in reversed(left[1:])]
    middle = left[0][0] + length + right[0][0]
    sizes = [n for n, _ in pieces] + [middle] + [n for n, _ in right[1:]]
    first = [a + 1 for _, a in pieces] + [left[0][1] + 1]
    # where each piece begins and ends in the document
    begins = [*first, *(a - n for n, a in right[1:])]
    ends = [None] * len(pieces) + [right[0][1]] + [a for _, a in right[1:]]
    best = None
    for lo in range(len(pieces) + 1):
        for hi in range(len(pieces), len(sizes)):
            n = sum(sizes[lo : hi + 1])
            if (hi - lo) * 5 <= n and (best is None or n > best[0]):
                best = (n, begins[lo], ends[hi])
    return best


class Detector:
    def __init__(self, items: list[tuple[int, str]], min_words: int, min_coverage: float):
        self.min_words, self.min_coverage = min_words, min_coverage
        self.auto = Automaton([(i, words_of(t)) for i, t in items])

    def find(self, text: str, every: bool = False) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, after last word, words, coverage) of the longest row of each item, or of ``every`` row that leaks."""
        auto = self.auto
        doc = words_of(text)
        nums = np.fromiter(map(auto.number.get, doc, [0] * len(doc)), np.int64, len(doc))
        seeds = auto.seeds(nums)
        if not seeds:
            return []
        by_item = defaultdict(list)
        coded = nums.tolist()
        # of a place that only a shorter suffix reaches, the words around are other items' own: none that stands in a seed is a slip
        words, bounds = taken = bytearray(len(doc)), bytearray(len(doc))
        last = -1
        for state, end, length in seeds:
            start = end - length
            words[start:end] = b"\x01" * length
            bounds[start + 1 : end] = b"\x01" * (length - 1)
            longest = end != last and (end == len(coded) or coded[end] not in auto.next[state])
            last = end
            for k, pos in auto.ends[state]:
                seq = auto.seqs[k]
                goes_on = end < len(coded) and pos + 1 < len(seq) and coded[end] == seq[pos + 1]
                began_before = start and pos >= length and coded[start - 1] == seq[pos - length]
                if not goes_on and not began_before:  # else its own longest match is another seed
                    by_item[k].append((longest, length, end, pos))
        out = []
        for k, found in by_item.items():
            item_id, item = auto.items[k]
            need = min(self.min_words, max(1, int(np.ceil(self.min_coverage * len(item)))))
            best, seen, leaked = None, set(), set()
            for longest, length, end, pos in sorted(found, reverse=True):
                if (end - pos, end) in seen:
                    continue
                row = rows_of_words(doc, item, end, pos, length, None if longest else taken)
                seen.update((e - p, e) for _, _, e, p in found if e - p == end - pos and row and row[1] < e <= row[2])
                if row and row[0] >= need:
                    leaked.add(row)
                    best = row if best is None or row[0] > best[0] else best
            for n, lo, hi in sorted(leaked) if every else [best] if best else []:
                out.append((item_id, lo, hi, n, min(1.0, n / len(item))))
        return out


def _finder(items: list[tuple[int, str]], min_words: int, min_coverage: float, spans: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(items, min_words, min_coverage)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                found = detector.find(text)
                at = places(text) if found and spans else None
                for item_id, lo, hi, n, cov in found:
                    rows.append((doc_id, item_id, at[lo][0] if at else 0, at[hi - 1][1] if at else 0, n, cov))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_char", "end_char", "n_words", "coverage"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, in the order of their ids."""
    block, size = [], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len(r["text"].split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def leak_spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_coverage: float = 1.0, spans: bool = True) -> DataFrame:
    """SPANS rows: for each document and item it leaks, the longest row of the item's words.

    A row leaks at ``min_words`` words, or at ``min_coverage`` of an item that has
    fewer. Null ids and texts are absent; an empty text leaks nothing; an item
    without words cannot leak. Repeated documents give repeated rows. Texts are read
    whole, however long; other columns are not read.
    """
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    out = None
    for block in _blocks(items):
        found = docs.mapInPandas(_finder(block, min_words, min_coverage, spans), SPANS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else documents.sparkSession.createDataFrame([], SPANS)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), once each."""
    return leak_spans(documents, items, spans=False).select("doc_id", "item_id").distinct()


def _cut_out(detector: Detector, text: str) -> tuple[str, int]:
    """The text without any span that leaks, and how many were cut; what a cut brings together is looked at again."""
    n = 0
    while found := detector.find(text, every=True):
        at = places(text)
        kept, end = [], 0
        for lo, hi in sorted({(at[lo][0], at[hi - 1][1]) for _, lo, hi, _, _ in found}):
            if hi > end:
                kept.append(text[end : max(end, lo)])
                n += lo >= end
                end = hi
        text = "".join([*kept, text[end:]])
    return text, n


CLEAN = "doc_id bigint, text string, n_spans int, n_chars bigint"


def _cutter(items: list[tuple[int, str]], min_words: int, min_coverage: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(items, min_words, min_coverage)
        for b in batches:
            done = [_cut_out(detector, t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [t for t, _ in done], "n_spans": b["n_spans"] + [n for _, n in done], "n_chars": b["n_chars"]})

    return run


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_coverage: float = 1.0, max_share: float = 0.5) -> DataFrame:
    """(doc_id, text, n_spans): texts with every leaked span cut out; a text of which they make more than ``max_share`` is left out.

    Spans are found and cut in one pass, which exchanges no text. A row of words counts
    as in ``leak_spans``; of an item that leaks in several places all are cut, and the
    result is searched again until none is left. Null ids and texts are absent; repeated documents stay so.
    """
    docs = documents.select("doc_id", "text", F.lit(0).alias("n_spans"), F.length("text").cast("bigint").alias("n_chars")).where("doc_id is not null and text is not null")
    for block in _blocks(items):
        docs = docs.mapInPandas(_cutter(block, min_words, min_coverage), CLEAN)
    return docs.where((F.col("n_chars") - F.length("text")) <= max_share * F.col("n_chars")).select("doc_id", "text", "n_spans")
