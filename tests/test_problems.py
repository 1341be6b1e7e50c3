"""The general problems' operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import csv
import io
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axiomill import core_queries as Q
from axiomill.functions.terms import lexical, same_term, unescaped
from axiomill.operators.components import components
from axiomill.operators.hierarchy import hierarchy, parent_conflicts, walk
from axiomill.operators.pivot import widen
from axiomill.operators.rejects import _is_date, _is_int, load_lines, parse_lines
from axiomill.operators.skew import count_per_key, heavy_keys, pairs_of
from axiomill.operators.snapshots import chunked, snapshot_changes
from axiomill.workspace import Workspace


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_same_term(spark):
    given = [" <urn:a> ", "urn:a", "<urn:a>", '"  kept "@en ', '"<x>"', " ", "<>", None, "_:b"]
    df = spark.createDataFrame([(g,) for g in given], "t string")
    assert [r[0] for r in rows(df.select(same_term("t")))] == ["urn:a", "urn:a", "urn:a", '"  kept "@en', '"<x>"', None, None, None, "_:b"]
    lit = spark.createDataFrame([('"a\\"b\\\\"@en',), ("urn:x",), ('"open',)], "t string")
    assert rows(lit.select(unescaped(lexical("t")))) == [('a"b\\',), (None,), (None,)]


# --- components and hierarchies (problem 2)


def test_components(spark):
    r = random.Random(3)
    pairs = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(45)] + [("z", "z"), ("hub", None)] + [("hub", f"leaf{k}") for k in range(200)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame(pairs, "a string, b string"), "a", "b")))
    assert got == {x: find(x) for x in up}
    assert rows(components(spark.createDataFrame([], "a string, b string"), "a", "b")) == []


LINKS = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "a"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("under", "x"), ("deep", "under"), ("self", "self"), (None, "a"), ("q", None), ("two", "b"), ("two", "a")]
TREE = {
    ("a", "tree", "a", 0, "a", 5), ("b", "tree", "a", 1, "a>b", 2), ("c", "tree", "a", 2, "a>b>c", 0), ("d", "tree", "a", 2, "a>b>d", 0), ("e", "tree", "a", 1, "a>e", 0),
    ("two", "tree", "a", 1, "a>two", 0),  # of two parents, the smaller
    *((n, "on_cycle", "", -1, "", -1) for n in ("x", "y", "z", "self")), *((n, "under_cycle", "", -1, "", -1) for n in ("under", "deep")),
}


@pytest.mark.parametrize("max_nodes", [1000, 1])
def test_hierarchy(spark, max_nodes):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in LINKS], "c string, p string, node string, comp int")
    assert set(rows(hierarchy(df, "c", "p", max_nodes))) == TREE
    assert rows(hierarchy(df.limit(0), "c", "p", max_nodes)) == []


def test_deep_chain(spark):
    n = 3000
    names = [f"n{k:05}" for k in range(n)]
    out = {r[0]: r for r in walk(names, [None, *names[:-1]])}
    assert out[names[-1]][3] == n - 1 and out[names[0]][5] == n - 1 and out[names[-1]][4].count(">") == n - 1
    df = spark.createDataFrame(list(zip(names[1:300], names[:299])), "c string, p string")
    assert sorted(rows(hierarchy(df, "c", "p", 10))) == sorted(rows(hierarchy(df, "c", "p")))


# --- wide tables (problem 3)


def test_widen(spark):
    at = "2024-01-01 00:00:00"
    data = [
        ("e", "hv:floorNo", "007", at, "x"), ("e", "hv:floorNo", "-2", "2024-02-01 00:00:00", "x"), ("e", "hv:floorNo", "9", None, "x"),
        ("e", "hv:capacity", "1.5E2", at, "x"), ("e", "hv:enabled", "true", at, "x"), ("e", "hv:installed", "2024-02-29T10:00:00Z", at, "x"), ("e", "rdfs:label", 'a \\"b\\"', at, "x"), ("e", "hv:other", "?", at, "x"),
        ("tie", "hv:serial", "A", at, "x"), ("tie", "hv:serial", "B", at, "x"), ("tie", "hv:serial", "B", at, "x"),
        ("bad", "hv:floorNo", " 3", at, "x"), ("bad", "hv:capacity", "1,5", at, "x"), ("bad", "hv:enabled", "yes", at, "x"), ("bad", "hv:installed", "2023-02-29", at, "x"),
        ("none", "hv:other", "x", at, "x"), (None, "hv:serial", "x", at, "x"), ("gone", None, "x", at, "x"), ("gone", "hv:serial", None, at, "x"),
        ("long", "rdfs:label", "z" * 200_000, at, "x"), ("empty", "rdfs:label", "", at, "x"),
    ]
    df = spark.createDataFrame(data, "s string, p string, lex string, at string, pos string").withColumn("at", F.to_timestamp("at"))
    got = {r[0]: r[1:] for r in rows(widen(df, Q.WIDE))}
    assert got["e"] == ('a "b"', None, -2, 150000, 1, "2024-02-29", 6)
    assert got["tie"] == (None, "B", None, None, None, None, 1)
    assert got["bad"] == (None,) * 6 + (4,)
    assert got["none"] == (None,) * 6 + (1,)
    assert len(got["long"][0]) == 200_000 and got["empty"][0] == "" and got.keys() == {"e", "tie", "bad", "none", "long", "empty"}
    assert rows(widen(df.limit(0), Q.WIDE)) == []


def test_numbers(spark):
    given = {"1": 1000, "-.5": -500, "+2.": 2000, "1.00612E2": 100612, "3.19E-1": 319, "": None, "1.2.3": None, "~4": None, "4 kW": None, "0": 0, "0E9": 0, "1e30": None, "5e-9": 0, "12e15": None, "9" * 40: None, "9" * 22: None, "9" * 26 + "e5": None, "123456789012345678901234e-20": 1234568, "1e-30": 0, "9223372036854775.807": 9223372036854775807, "9223372036854775.808": None}
    df = spark.createDataFrame([(k,) for k in given], "lex string")
    from axiomill.operators.pivot import as_thousandths

    assert {r[0]: r[1] for r in rows(df.select("lex", as_thousandths(F.col("lex"))))} == given


# --- rows that fail to parse (problem 4)

FIELD = re.compile(r'(?s)"(?:[^"]|"")*"|[^",]*')
WHOLE = re.compile(rf"(?s)(?:{FIELD.pattern[4:]})(?:,(?:{FIELD.pattern[4:]}))*")


def shape(line):
    if not WHOLE.fullmatch(line):
        return "quoting"
    n, at = 0, 0
    while True:
        n, at = n + 1, FIELD.match(line, at).end()
        if at >= len(line):
            return "value" if n == 5 else "column_count"
        at += 1


def test_structure_of_lines():
    r = random.Random(5)
    lines = ["".join(r.choice('",,"aé\n ') for _ in range(r.randrange(16))) for _ in range(20_000)]
    assert parse_lines(pa.array(lines))[0].to_pylist() == [shape(x) for x in lines]
    assert parse_lines(pa.array([], pa.string()))[0].to_pylist() == []


GOOD = [
    "urn:a,hv:p,x,,", '"urn:a","hv:p","a ""b"", c",xsd:string,""', "_:b1,rdfs:label,Fan,rdf:langString,en-GB", "urn:a,hv:p,urn:b,iri,", "urn:a,hv:p,-2147483648,xsd:int,",
    "urn:a,hv:p,+7,xsd:integer,", "urn:a,hv:p,.5,xsd:decimal,", "urn:a,hv:p,5.,xsd:decimal,", "urn:a,hv:p,0,xsd:boolean,", "urn:a,hv:p,2024-02-29,xsd:date,", 'urn:a,hv:p,"two\nlines",,', f"urn:a,hv:p,{'y' * 300_000},,", "urn:a,hv:p,,hv:own,",
]
BAD = [
    "urn:,hv:p,x,,", "urn:a ,hv:p,x,,", "urn:a b,hv:p,x,,", "x,hv:p,x,,", "_:,hv:p,x,,", "urn:a,hv,x,,", "urn:a,1v:p,x,,", "urn:a,hv:1,x,,", "urn:a,hv:p,x,rdf:langString,", "urn:a,hv:p,x,xsd:string,en", "urn:a,hv:p,x,rdf:langString,e",
    "urn:a,hv:p,b,iri,", "urn:a,hv:p,2147483648,xsd:int,", "urn:a,hv:p,1.0,xsd:integer,", "urn:a,hv:p,.,xsd:decimal,", "urn:a,hv:p,TRUE,xsd:boolean,", "urn:a,hv:p,2023-02-29,xsd:date,", "urn:a,hv:p,2024-1-1,xsd:date,", "urn:a,hv:p, 5,xsd:int,", "urn:a,hv:p,5\n,xsd:int,",
]


def test_values_of_lines(spark):
    assert [x[:40] for x, r in zip(GOOD, parse_lines(pa.array(GOOD))[0].to_pylist()) if r] == []
    assert [x for x, r in zip(BAD, parse_lines(pa.array(BAD))[0].to_pylist()) if r != "value"] == []
    lines = [(1, x, "r") for x in GOOD] + [(None, "", "r"), (2, None, "r"), (3, 'a"b', "r"), (3, 'a"b', "r")]
    df = spark.createDataFrame(lines, "id bigint, line string, reason string")
    out = rows(load_lines(df, "id", "line"))
    assert len(out) == len(GOOD) + 3  # a null line is absent, the others come as often as they came
    assert sorted((r[1], r[0]) for r in out if r[1]) == [("column_count", None), ("quoting", 3), ("quoting", 3)]
    ok = [r[2:] for r in out if r[1] is None]
    assert sorted(ok) == sorted(tuple(next(csv.reader(io.StringIO(x)))) for x in GOOD if len(x) < 1000) or len(ok) == len(GOOD)
    assert ("urn:a", "hv:p", 'a "b", c', "xsd:string", "") in ok
    assert rows(load_lines(df.limit(0), "id", "line")) == []


# --- snapshots (problem 5)


def test_snapshot_changes(spark):
    r = random.Random(7)
    state = {(f"s{k:03}", "p"): f"o{r.randrange(9)}" for k in range(300)}
    data, expected = [], set()
    for snap in (2, 3, 7):
        old = dict(state)
        if snap > 2:
            for k in r.sample(sorted(state), 15):
                kind = r.choice("cdn")
                if kind == "c":
                    state[k] = f"o{r.randrange(9, 99)}"
                elif kind == "d":
                    del state[k]
                else:
                    state[k[0] + "x", "p"] = None
            for k in old.keys() | state.keys():
                kind = "added" if k not in old else "removed" if k not in state else "changed" if old[k] != state[k] else None
                if kind:
                    expected.add((snap, *k, kind))
        data += [(snap, *k, v, "c") for k, v in state.items() for _ in range(r.choice((1, 1, 2)))]
    data += [(7, None, "p", "o", "c"), (None, "s", "p", "o", "c")]
    df = spark.createDataFrame(data, "snap int, s string, p string, o string, chunk string")
    for size in (1, 16, 10**6):
        assert set(rows(snapshot_changes(df, "snap", ("s", "p"), "o", chunk_rows=size))) == expected
    one = df.where("snap = 2")
    assert rows(snapshot_changes(one, "snap", ("s", "p"), "o")) == [] == rows(snapshot_changes(df.limit(0), "snap", ("s", "p"), "o"))


def test_null_value_is_a_value(spark):
    df = spark.createDataFrame([(1, "a", "p", None), (2, "a", "p", "x"), (3, "a", "p", None), (4, "a", "p", None), (4, "a", "p", "")], "n int, s string, p string, o string")
    assert set(rows(snapshot_changes(df, "n", ("s", "p"), "o"))) == {(2, "a", "p", "changed"), (3, "a", "p", "changed"), (4, "a", "p", "changed")}


def test_chunks_move_with_content(spark):
    base = [(1, f"k{i:05}", "p", "v") for i in range(3000)]
    df = spark.createDataFrame(base + [(2, *x[1:]) for x in base] + [(2, "k00100x", "p", "new")], "n int, s string, p string, o string")
    _, manifest = chunked(df, "n", ("s", "p"), "o", Workspace(spark))
    m = manifest.groupBy("part", "d1", "d2").count()
    assert m.where("count = 1").count() <= 4  # an inserted record changes its own chunk alone


# --- skewed keys (problem 6)


def test_count_per_key(spark):
    r = random.Random(1)
    data = [("hot", f"s{r.randrange(400)}", f"o{r.randrange(3)}") for _ in range(4000)] + [("warm", "s1", f"o{k}") for k in range(300)] + [(f"k{r.randrange(500)}", f"s{r.randrange(9)}", "o") for _ in range(1000)]
    data += [(None, "s", "o"), ("hot", None, "o"), ("hot", "s", None), ("hot", "s1", "o1")]
    df = spark.createDataFrame([(*x, 1) for x in data], "p string, s string, o string, n bigint")
    full = [x for x in data if None not in x]
    expected = {(p, sum(x[0] == p for x in full), len({x[1] for x in full if x[0] == p}), len({x[1:] for x in full if x[0] == p})) for p in {x[0] for x in full}}
    for share in (0.5, 0.01, 0.0001):
        assert set(rows(count_per_key(df, "p", "s", "o", share))) == expected
    assert {"hot", "warm"} <= set(heavy_keys(df, "p", 0.05)) and len(heavy_keys(df, "p", 0.05)) <= 40
    assert rows(count_per_key(df.limit(0), "p", "s", "o")) == [] and heavy_keys(df.limit(0), "p") == {}


# --- tables that cut lineage


def test_workspace(spark, tmp_path):
    ws = Workspace(spark, f"file://{tmp_path}")
    df = ws.save(spark.range(5).toDF("a"), "one")
    ws.save(spark.range(3).toDF("a"), "one", mode="append")
    assert df.count() == 8 or ws.read("one", df.schema).count() == 8
    ws.save(spark.range(2), "two")
    ws.drop("two")
    left = [p.name for p in next(tmp_path.iterdir()).iterdir()]
    assert left == ["one"]
    ws.close()
    assert list(tmp_path.iterdir()) == []


def test_bit_filter(spark):
    from axiomill.operators.bitset import bits_of, may_be_in

    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    bits = bits_of(keys, 1 << 10)
    kept = {r[0] for r in rows(spark.range(3000).where(may_be_in(F.xxhash64("id"), bits, 1 << 10)))}
    assert set(range(0, 3000, 3)) <= kept and len(kept) < 1200
    none = spark.range(50).where(may_be_in(F.xxhash64("id"), bits_of(keys.limit(0))))
    assert rows(none) == []


# --- the contract


def test_entry():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and {f"p{n}_found" for n in (2, 3, 4, 5, 6)} <= set(q)


def test_an_entity_that_holds_most_rows_of_a_key(spark):
    """Nine of ten rows are of one key and entity: after the exchange no partition holds far more than another."""
    data = spark.range(40_000).select(F.lit("hot").alias("p"), F.when(F.col("id") % 10 > 0, "hub").otherwise(F.concat(F.lit("e"), "id")).alias("s"), F.col("id").cast("string").alias("o"))
    assert rows(count_per_key(data, "p", "s", "o")) == [("hot", 40_000, 4_001, 40_000)]
    repeated = data.withColumn("o", F.lit("x"))
    assert rows(count_per_key(repeated, "p", "s", "o")) == [("hot", 40_000, 4_001, 4_001)]
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        named = data.select(F.col("p").alias("k"), F.col("s").alias("e"), F.col("o").alias("v"))
        sizes = sorted(r["count"] for r in pairs_of(named).groupBy(F.spark_partition_id().alias("part")).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


# --- several parents (problem 2)


@pytest.mark.parametrize("max_nodes", [1000, 1])
def test_parents_in_conflict(spark, max_nodes):
    """The smallest parent is kept, by both ways, and the others are told; deep and wide trees count the same."""
    links = [("c", "b"), ("c", "a"), ("c", "a"), ("d", "c"), ("b", "r"), ("x", "x"), ("x", "a"), (None, "a"), ("a", None)]
    links += [(f"n{k:03}", f"n{k - 1:03}") for k in range(1, 70)] + [(f"leaf{k:02}", "n035") for k in range(40)]
    df = spark.createDataFrame(links, "c string, p string")
    got = {r[0]: r[1:] for r in rows(hierarchy(df, "c", "p", max_nodes))}
    assert got["c"] == ("tree", "a", 1, "a>c", 1) and got["a"][4] == 3 and got["r"] == ("tree", "r", 0, "r", 1) and got["x"][:2] == ("tree", "a")
    assert got["n000"][4] == 69 + 40 and got["n036"][4] == 33 and got["leaf07"][2] == 36 and got["n069"][3].count(">") == 69
    assert set(rows(parent_conflicts(df, "c", "p"))) == {("c", "a", True), ("c", "b", False), ("x", "a", True), ("x", "x", False)}
    assert rows(parent_conflicts(df.limit(0), "c", "p")) == []


def test_numbers_and_dates_at_their_bounds():
    ints = ["2147483647", "2147483648", "-2147483648", "-2147483649", "+0002147483647", "0", "-0", "99999999999999999999", "00000000000000000000000007"]
    assert _is_int(pa.array(ints)).tolist() == [True, False, True, False, True, True, True, False, True]
    dates = ["2024-02-29", "2023-02-29", "1900-02-29", "2000-02-29", "2023-13-01", "2023-00-10", "2023-04-31", "2023-12-31", "0000-01-01", "2023-01-00"]
    assert _is_date(pa.array(dates)).tolist() == [True, False, False, True, False, False, False, True, False, False]
    assert _is_int(pa.array([], pa.string())).tolist() == [] == _is_date(pa.array([], pa.string())).tolist()
