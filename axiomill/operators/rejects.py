"""Problem 4: load delimited records, and set apart those that fail with the reason.

Structural indexing over whole Arrow batches: the bytes of all records of a batch
are one numpy array; a mask of its quotes and the prefix parity of that mask tell
which commas are delimiters, for all records at once, and where every record ends.
No byte is looked at in a Python loop. Counts and typed checks then give each
record its first reason, in the order quoting, column_count, value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("s", "p", "object", "datatype", "lang")
QUOTE, COMMA = 0x22, 0x2C
# every blank of Unicode, the no-break spaces among them
NON_BLANK = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]+"
IRI = rf"urn:{NON_BLANK}"
SUBJECT = rf"\A(?:{IRI}|_:\w+)\z"
PREDICATE = r"\A[A-Za-z]+:[A-Za-z]\w*\z"
LANG = r"\A[A-Za-z]{2,3}(?:-[A-Za-z0-9]+)*\z"
OBJECT = {
    "iri": rf"\A{IRI}\z",
    "xsd:integer": r"\A[+-]?[0-9]+\z",
    "xsd:int": r"\A[+-]?[0-9]+\z",
    "xsd:decimal": r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z",
    "xsd:boolean": r"\A(?:true|false|1|0)\z",
    "xsd:date": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
}
SCHEMA = "reason string, " + ", ".join(f"{c} string" for c in COLUMNS)


def index_records(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Delimiter positions, record of each, and per record whether its quoting is whole.

    ``data`` holds the records one after another; ``ends`` the end of each.
    """
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1]]) if n else ends
    quote = data == QUOTE
    at = np.flatnonzero(quote)
    # quotes before each record: parity counts from the record's own start
    before = np.searchsorted(at, starts)
    inside = np.searchsorted(at, ends) - before
    whole = inside % 2 == 0
    commas = np.flatnonzero(data == COMMA)
    owner = np.searchsorted(ends, commas, side="right")
    parity = (np.searchsorted(at, commas) - before[owner]) % 2
    delims, owner = commas[parity == 0], owner[parity == 0]
    # an opening quote must begin its field, a closing one end it, unless doubled inside
    odd = (np.arange(len(at)) - before[np.searchsorted(ends, at, side="right")]) % 2 if len(at) else at
    if len(at):
        rec = np.searchsorted(ends, at, side="right")
        first, last = at == starts[rec], at == ends[rec] - 1
        prev, nxt = data[np.maximum(at - 1, 0)], data[np.minimum(at + 1, len(data) - 1)]
        near_open = first | (prev == COMMA) | (prev == QUOTE)
        near_close = last | (nxt == COMMA) | (nxt == QUOTE)
        fine = np.where(odd == 0, near_open, near_close)
        # a quote that opens after a quote is the second of a doubled pair: then that pair lies in a quoted field,
        # which holds when the quote before it closes (odd) and stands right there
        whole &= np.bincount(rec, weights=~fine, minlength=n) == 0
    return delims, owner, whole


def _valid(s, p, obj, dtype, lang) -> np.ndarray:
    def like(col, pattern):
        return pc.match_substring_regex(col, pattern).to_numpy(zero_copy_only=False)

    tagged = pc.equal(dtype, "rdf:langString").to_numpy(zero_copy_only=False)
    has_lang = pc.greater(pc.binary_length(lang), 0).to_numpy(zero_copy_only=False)
    ok = like(s, SUBJECT) & like(p, PREDICATE) & (tagged == has_lang) & (~has_lang | like(lang, LANG))
    for kind, pattern in OBJECT.items():
        of = pc.equal(dtype, kind).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(of & ok)
        if not len(rows):
            continue
        vals = obj.take(pa.array(rows))
        good = like(vals, pattern)
        if kind == "xsd:int":
            good[good] = _is_int(vals.filter(pa.array(good)))
        elif kind == "xsd:date":
            good[good] = _is_date(vals.filter(pa.array(good)))
        ok[rows[~good]] = False
    return ok


def _is_int(numbers: pa.Array) -> np.ndarray:
    """Whether digits with an optional sign lie within 32 bits."""
    body = pc.replace_substring_regex(numbers, r"\A[+-]?0*", "")
    short = pc.less_equal(pc.binary_length(body), 10).to_numpy(zero_copy_only=False)
    size = pc.cast(pc.replace_substring_regex(pc.if_else(pa.array(short), body, ""), r"\A\z", "0"), pa.int64()).to_numpy(zero_copy_only=False)
    least = pc.starts_with(numbers, "-").to_numpy(zero_copy_only=False)
    return short & (size < 2**31 + least)


def _is_date(dates: pa.Array) -> np.ndarray:
    """Whether ``YYYY-MM-DD`` is a day of the calendar; there is no year 0."""
    part = lambda a, b: pc.cast(pc.utf8_slice_codeunits(dates, a, b), pa.int64()).to_numpy(zero_copy_only=False)
    y, m, d = part(0, 4), part(5, 7), part(8, 10)
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where((m >= 1) & (m <= 12), m, 0)]
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return (y > 0) & (d >= 1) & (d <= days + (leap & (m == 2)))


def parse_lines(lines: pa.Array) -> list[pa.Array]:
    """reason and the five columns (null where the line fails) of an array of lines without nulls."""
    lines = pa.concat_arrays([lines.cast(pa.large_string())])
    n = len(lines)
    offsets = np.frombuffer(lines.buffers()[1], np.int64, n + 1, lines.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends, starts = offsets[1:] - offsets[0], offsets[:-1] - offsets[0]
    reason = np.full(n, None, object)
    # records of no bytes have no quotes and one empty column; indexing is over the others
    some = np.flatnonzero(ends > starts)
    delims, owner, whole = index_records(data, ends[some])
    reason[some[~whole]] = "quoting"
    count = np.ones(n, np.int64)
    count[some] += np.bincount(owner, minlength=len(some)).astype(np.int64)
    wrong = (count != len(COLUMNS)) & (reason == None)  # noqa: E711
    reason[wrong] = "column_count"
    good = np.flatnonzero(reason == None)  # noqa: E711
    pos = np.full(n, -1, np.int64)
    pos[some] = np.arange(len(some))
    keep = np.isin(owner, pos[good])
    cuts = delims[keep].reshape(len(good), len(COLUMNS) - 1)
    lo = np.column_stack([starts[good], cuts + 1])
    hi = np.column_stack([cuts, ends[good]])
    fields = []
    for k in range(len(COLUMNS)):
        a, b = lo[:, k].copy(), hi[:, k].copy()
        quoted = (b - a >= 2) & (data[np.minimum(a, max(len(data) - 1, 0))] == QUOTE) if len(data) else np.zeros(len(good), bool)
        a[quoted] += 1
        b[quoted] -= 1
        fields.append(pc.replace_substring(_slices(data, a, b), '""', '"'))
    ok = _valid(*fields)
    reason[good[~ok]] = "value"
    back = np.full(n, -1, np.int64)
    back[good[ok]] = np.flatnonzero(ok)
    take = pa.array(back, mask=back < 0)
    return [pa.array(reason, pa.string()), *[f.take(take).cast(pa.string()) for f in fields]]


def _slices(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    size = b - a
    to = np.concatenate([[0], np.cumsum(size)])
    idx = np.arange(to[-1]) + np.repeat(a - to[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(to.astype(np.int64).tobytes()), pa.py_buffer(data[idx].tobytes())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = b.column(1)
        if isinstance(lines, pa.ChunkedArray):
            lines = lines.combine_chunks()
        yield pa.RecordBatch.from_arrays([b.column(0), *parse_lines(lines)], names=["key", "reason", *COLUMNS])


def load_lines(df: DataFrame, key: str, line: str) -> DataFrame:
    """(key, reason, s, p, object, datatype, lang): reason is null and the columns are set, or the other way round.

    A null line is absent; a line of no characters has one column and fails as
    column_count. Lines repeat as often as they came. Fields are not trimmed; quotes
    around a field are dropped and doubled quotes inside it made single. The key may
    be null and of any type.
    """
    named = df.select(F.col(key).alias("key"), F.col(line).alias("line")).where("line is not null")
    kind = named.schema["key"].dataType.simpleString()
    return named.mapInArrow(_parse, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
