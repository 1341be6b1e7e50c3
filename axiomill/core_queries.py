"""The queries of the general problems over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.functions.terms import lexical, same_term
from axiomill.operators import hierarchy as H
from axiomill.operators import pivot as P
from axiomill.operators.rejects import load_lines
from axiomill.operators.skew import count_per_key
from axiomill.operators.snapshots import snapshot_changes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent) of the hierarchy rows, either direction of statement."""
    rows = table(spark, sf_dir, "part_links")
    p, s, o = same_term("p"), same_term("s"), same_term("o")
    rows = rows.where(p.isin("hv:partOf", "rdfs:subClassOf", "hv:hasPart"))
    down = p == "hv:hasPart"
    return rows.select(F.when(down, o).otherwise(s).alias("child"), F.when(down, s).otherwise(o).alias("parent"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hierarchy(part_links(spark, sf_dir), "child", "parent")


def p2_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are given several parents, and the one that the hierarchy keeps."""
    return H.parent_conflicts(part_links(spark, sf_dir), "child", "parent")


WIDE = [
    P.Attribute("rdfs:label", "label_text", P.as_text),
    P.Attribute("hv:serial", "serial", P.as_text),
    P.Attribute("hv:floorNo", "floor_no", P.as_integer),
    P.Attribute("hv:capacity", "capacity_milli", P.as_thousandths),
    P.Attribute("hv:enabled", "enabled", P.as_flag),
    P.Attribute("hv:installed", "installed", P.as_date),
]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "triples")
    t = t.select(same_term("s").alias("s"), same_term("p").alias("p"), same_term("o").alias("o"), F.col("asserted_at").alias("at"))
    return P.widen(t.select("s", "p", lexical("o").alias("lex"), "at"), WIDE)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_lines(table(spark, sf_dir, "raw_lines"), "line_id", "line").where("reason is not null").select("line_id", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines, as triples."""
    return load_lines(table(spark, sf_dir, "raw_lines"), "line_id", "line").where("reason is null").drop("reason")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "snapshots").select("snap_no", same_term("s").alias("s"), same_term("p").alias("p"), same_term("o").alias("o"))
    out = snapshot_changes(t, "snap_no", ("s", "p"), "o")
    return out.select(F.col("snap").cast("int").alias("snap_no"), F.col("k1").alias("s"), F.col("k2").alias("p"), "change_kind")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "triples").select(same_term("p").alias("p"), same_term("s").alias("s"), same_term("o").alias("o"))
    out = count_per_key(t, "p", "s", "o")
    return out.select("p", "n_rows", F.col("n_entities").alias("n_subjects"), F.col("n_pairs").alias("n_triples"))


def nt(c: str) -> str:
    """SQL of ``same_term``."""
    t = f"trim({c}, chr(32) || chr(9) || chr(13) || chr(10))"
    bare = f"trim(substring({t}, 2, length({t}) - 2), chr(32) || chr(9) || chr(13) || chr(10))"
    return f"nullif(case when {t} like '<%>' then {bare} else {t} end, '')"


def queries() -> dict:
    return {"p2_found": p2_found, "p2_conflicts": p2_conflicts, "p3_found": p3_found, "p4_found": p4_found, "p4_loaded": p4_loaded, "p5_found": p5_found, "p6_found": p6_found}


LIT = r"""^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^(\S+))?$"""
FIELD = r"""(?:"(?:[^"]|"")*"|[^",]*)"""


def _line_sql(loaded: bool) -> str:
    f = FIELD
    blank = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
    iri = rf"urn:[^{blank}]+"
    whole = rf"{f}(?:,{f})*"
    five = rf"({f}),({f}),({f}),({f}),({f})"
    cell = lambda k: f"(case when length(c[{k}]) >= 2 and c[{k}] like '\"%' then replace(substring(c[{k}], 2, length(c[{k}]) - 2), '\"\"', '\"') else c[{k}] end)"
    head = f"""
with q as (select line_id, line, regexp_full_match(line, '{whole}', 's') as quoted, regexp_full_match(line, '{five}', 's') as five from raw_lines where line is not null),
c as (select *, case when quoted and five then [regexp_extract(line, '^{five}$', 1, 's'), regexp_extract(line, '^{five}$', 2, 's'), regexp_extract(line, '^{five}$', 3, 's'), regexp_extract(line, '^{five}$', 4, 's'), regexp_extract(line, '^{five}$', 5, 's')] end as c from q),
v as (select line_id, quoted, five, {cell(1)} s, {cell(2)} p, {cell(3)} object, {cell(4)} datatype, {cell(5)} lang from c),
r as (select *, case when not quoted then 'quoting' when not five then 'column_count'
  when not (regexp_full_match(s, '{iri}|_:\\w+') and regexp_full_match(p, '[A-Za-z]+:[A-Za-z]\\w*')
    and ((datatype = 'rdf:langString') = (lang <> '')) and (lang = '' or regexp_full_match(lang, '[A-Za-z]{{2,3}}(?:-[A-Za-z0-9]+)*'))
    and case datatype when 'iri' then regexp_full_match(object, '{iri}')
      when 'xsd:integer' then regexp_full_match(object, '[+-]?[0-9]+')
      when 'xsd:int' then regexp_full_match(object, '[+-]?[0-9]+') and coalesce(try_cast(object as bigint) between -2147483648 and 2147483647, false)
      when 'xsd:decimal' then regexp_full_match(object, '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)')
      when 'xsd:boolean' then object in ('true', 'false', '1', '0')
      when 'xsd:date' then regexp_full_match(object, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(object as date) is not null
      else true end) then 'value' end as reason from v)"""
    if loaded:
        return head + " select line_id, s, p, object, datatype, lang from r where reason is null"
    return head + " select line_id, reason from r where reason is not null"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
with recursive rows as (select {nt("p")} p, {nt("s")} s, {nt("o")} o from part_links),
e as (select case when p = 'hv:hasPart' then o else s end c, case when p = 'hv:hasPart' then s else o end par from rows
      where p in ('hv:partOf', 'rdfs:subClassOf', 'hv:hasPart') and s is not null and o is not null),
up as (select c, min(par) par from e group by c),
nodes as (select c n from up union select par from up),
tree as (select n, n root, 0::bigint d, n path from nodes where n not in (select c from up)
         union all select u.c, t.root, t.d + 1, t.path || '>' || u.c from up u join tree t on u.par = t.n),
anc as (select u.c n, u.par a from up u union select x.n, u.par from anc x join up u on u.c = x.a),
below as (select a, count(*) k from anc where n <> a group by a)
select n.n node, case when t.n is not null then 'tree' when exists (select 1 from anc x where x.n = n.n and x.a = n.n) then 'on_cycle' else 'under_cycle' end node_state,
  coalesce(t.root, '') root_node, coalesce(t.d, -1)::bigint node_depth, coalesce(t.path, '') node_path,
  (case when t.n is null then -1 else coalesce(b.k, 0) end)::bigint n_desc
from nodes n left join tree t on t.n = n.n left join below b on b.a = n.n""",
        "p2_conflicts": f"""
with rows as (select {nt("p")} p, {nt("s")} s, {nt("o")} o from part_links),
e as (select distinct case when p = 'hv:hasPart' then o else s end node, case when p = 'hv:hasPart' then s else o end parent from rows
      where p in ('hv:partOf', 'rdfs:subClassOf', 'hv:hasPart') and s is not null and o is not null)
select node, parent, parent = min(parent) over (partition by node) kept from e qualify count(*) over (partition by node) > 1""",
        "p3_found": f"""
with t as (select {nt("s")} s, {nt("p")} p, {nt("o")} o, asserted_at from triples),
l as (select s, p, regexp_extract(o, '{LIT}', 1, 's') lex, asserted_at from t where s is not null and p is not null and regexp_matches(o, '{LIT}', 's')),
d as (select s, p, lex from l qualify row_number() over (partition by s, p order by asserted_at desc nulls last, lex desc) = 1),
w as (select s, count(*) n_attrs, max(lex) filter (p = 'rdfs:label') a, max(lex) filter (p = 'hv:serial') b, max(lex) filter (p = 'hv:floorNo') c,
  max(lex) filter (p = 'hv:capacity') e, max(lex) filter (p = 'hv:enabled') f, max(lex) filter (p = 'hv:installed') g from d group by s)
select s, regexp_replace(a, '\\\\(["\\\\])', '\\1', 'g') label_text, regexp_replace(b, '\\\\(["\\\\])', '\\1', 'g') serial,
  case when regexp_full_match(c, '[+-]?[0-9]+') then try_cast(c as bigint) end floor_no,
  case when regexp_full_match(e, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then
    try_cast(round(case when regexp_matches(e, '[eE]') then cast(e as double)::decimal(38, 9) else try_cast(e as decimal(38, 9)) end * 1000) as bigint) end capacity_milli,
  (case when f in ('true', '1') then 1 when f in ('false', '0') then 0 end)::bigint enabled,
  case when regexp_full_match(g, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z)?') and try_cast(g[1:10] as date) is not null then g[1:10] end installed,
  n_attrs::bigint n_attrs from w""",
        "p4_found": _line_sql(False),
        "p4_loaded": _line_sql(True),
        "p5_found": f"""
with r as (select distinct snap_no, {nt("s")} s, {nt("p")} p, {nt("o")} o from snapshots),
v as (select snap_no, s, p, list_sort(list(coalesce('v' || o, 'n'))) o from r where s is not null and p is not null and snap_no is not null group by all),
n as (select snap_no, lag(snap_no) over (order by snap_no) prev from (select distinct snap_no from v)),
a as (select n.snap_no, v.s, v.p, v.o from v join n using (snap_no) where prev is not null),
b as (select n.snap_no, v.s, v.p, v.o from v join n on n.prev = v.snap_no)
select * from (select coalesce(a.snap_no, b.snap_no)::int snap_no, coalesce(a.s, b.s) s, coalesce(a.p, b.p) p,
  case when b.s is null then 'added' when a.s is null then 'removed' when a.o <> b.o then 'changed' end change_kind
  from a full join b on a.snap_no = b.snap_no and a.s = b.s and a.p = b.p) where change_kind is not null""",
        "p6_found": f"""
with t as (select {nt("p")} p, {nt("s")} s, {nt("o")} o from triples)
select p, count(*) n_rows, count(distinct s) n_subjects, count(distinct (s, o)) n_triples from t
where p is not null and s is not null and o is not null group by p""",
    }
