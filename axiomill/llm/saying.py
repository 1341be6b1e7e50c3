"""What a statement's text says: its words and numbers, and when two texts say the same.

Two texts say the same if they differ only in how words are written: case, marks,
punctuation, order, slips, shortened words, missing articles, blanks inside words.
Another number, or another word in place of one, makes another statement.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+|_\d{3}(?!\d))*")
ARTICLES = frozenset({"a", "an", "the"})
THOUSANDS = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?")
# digits in groups of three: an apostrophe can only join them, a blank may also part two numbers
JOINED = re.compile(r"(?<!\d)(?<!\d[.,])\d{1,3}(?:['\u2018\u2019\u02BC`]\d{3})+(?!['\u2018\u2019\u02BC`]?\d)")
PARTED = re.compile(r"(?<!\d)(?<!\d[.,])[1-9]\d{0,2}(?:\s\d{3})+(?:\.\d+|,\d{1,2}(?!\d))?(?![.,]?\d)")

MAY_PART = re.compile(r"\d\s\d\d\d")
APOSTROPHES = re.compile(r"\d['\u2018\u2019\u02BC`]\d")


def tokens(text: str) -> list[str]:
    """Words and numbers of a text, without case, marks, ligatures and punctuation.

    Groups of digits parted by single blanks, which may be one number or several, are one token joined by ``_``.
    """
    if text.isascii():
        plain = text.lower()
    else:
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
        plain = "".join(c for c in plain if c < "\u0300" or not unicodedata.combining(c))
    plain = plain.replace("_", ";")
    if APOSTROPHES.search(plain):
        plain = JOINED.sub(lambda m: re.sub(r"\D", "", m.group()), plain)
    if MAY_PART.search(plain):
        plain = PARTED.sub(lambda m: re.sub(r"\s", "_", m.group()), plain)
    return [t.replace(",", "") if "," in t and THOUSANDS.fullmatch(t) else t for t in TOKEN.findall(plain)]


def groups(token: str) -> list[str]:
    """The digits of a number in groups of three from the right, with its fraction in the last: alike however it is parted."""
    if len(token) <= 3 and "_" not in token and "." not in token and "," not in token:
        return [token]
    out = []
    for part in token.split("_"):
        whole = re.match(r"\d+", part).end()
        cuts = [0, *range(whole % 3 or 3, whole, 3), len(part)]
        out += [part[a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def slips(a: str, b: str, most: int) -> bool:
    """At most so many letters wrong, missing, added or swapped with the next."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def shortened(short: str, full: str) -> bool:
    """A word cut after two or more letters, or left with some of its letters in their order, the first and one of the last two among them."""
    if len(short) >= len(full) or len(short) < 2 or short[0] != full[0]:
        return False
    if full.startswith(short):
        return True
    rest = iter(full)
    return all(c in rest for c in short) and short[-1] in full[-2:] and len(short) <= len(full) * 0.6 and not set(short[1:]) & set("aeiou")


def same_word(a: str, b: str) -> bool:
    most = 0 if max(len(a), len(b)) < 3 else 1 if max(len(a), len(b)) < 5 else 2
    return slips(a, b, most) or shortened(a, b) or shortened(b, a)


def same_numbers(a: list[str], b: list[str]) -> bool:
    """Whether two bags of numbers are equal in some reading of those whose groups are parted by blanks."""
    if Counter(g for t in a for g in groups(t)) != Counter(g for t in b for g in groups(t)):
        return False
    x, y = Counter(a), Counter(b)

    def placed(whole: list[list[str]], runs: list[list[str]]) -> bool:
        """Whether the numbers stand in the runs beside one another; what is left of the runs is read group by group."""
        if not whole:
            return True
        first, rest = whole[0], whole[1:]
        n = len(first)
        for k, run in enumerate(runs):
            for at in range(len(run) - n + 1):
                if run[at : at + n] == first and placed(rest, [*runs[:k], run[:at], run[at + n :], *runs[k + 1 :]]):
                    return True
        return False

    def fits(one: Counter, other: Counter) -> bool:
        whole = [g for t in (one - other).elements() if "_" not in t and len(g := groups(t)) > 1]
        return placed(sorted(whole, key=len, reverse=True), [groups(t) for t in other.elements() if "_" in t])

    return fits(x, y) and fits(y, x)


def compounds(known: frozenset[str]) -> frozenset[str]:
    """Known words that two other known words make without the blank between them."""
    return frozenset(w for w in known if any(w[:k] in known and w[k:] in known for k in range(1, len(w))))


def same_saying(a: str, b: str, known: frozenset[str] | set[str]) -> bool:
    """Whether two bags of words (sorted, joined by blanks) differ only in how words are written.

    Numbers must be equal, in one reading where a blank may join or part them; articles may be missing. A word may stand for another only if one of them is no
    word of the known vocabulary: two known words are different words however close.
    """
    x, y = Counter(a.split(" ")), Counter(b.split(" "))
    left, right = list((x - y).elements()), list((y - x).elements())
    if any(t[:1].isdigit() for t in left + right):
        numbers = [[t for t in bag.elements() if t[:1].isdigit()] for bag in (x, y)]
        if not any("_" in t for bag in numbers for t in bag) or not same_numbers(*numbers):
            return False
        left, right = ([t for t in side if not t[:1].isdigit()] for side in (left, right))
    # a blank lost or added: two words of one side make one of the other
    for one, two in ((left, right), (right, left)):
        for w in [w for w in one if len(one) < len(two)]:
            pair = next(((u, v) for u in two for v in two if u != v and u + v == w), None)
            if pair:
                one.remove(w)
                two.remove(pair[0])
                two.remove(pair[1])
    # telegram style: an article left out on either side changes nothing
    if len(left) != len(right):
        left, right = [w for w in left if w not in ARTICLES], [w for w in right if w not in ARTICLES]
    if len(left) != len(right) or len(left) > max(4, sum(x.values()) // 2):
        return False
    for w in sorted(left, key=len, reverse=True):
        fits = [v for v in right if not (w in known and v in known) and same_word(w, v)]
        if not fits:
            return False
        right.remove(min(fits, key=lambda v: (v[0] != w[0], abs(len(v) - len(w)))))
    return True
