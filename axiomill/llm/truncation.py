"""Problem 10: texts that were cut before their end, in SQL alone.

Word trigrams are counted inside all texts and at their ends. The last trigrams of
a text, at distance 0 to 5 words from its end, are joined to those counts: one
of which almost no occurrence is an end, by share and by the upper confidence bound of that share, shows a cut; one that many texts have there shows a text that merely
ends. Digits count as one sign, so figures do not split the counts, and ends are
counted once a family, so copies of one text prove nothing.

Distances above 0 let the words before a half word speak. Only trigrams that reach into
an unfinished last sentence can show a usual end, as those before its beginning end a
whole sentence; where the very last trigram is frequent and never last, and no mark
closes the text, it decides alone. Counts are kept for a
source as well, as one source may end its texts where others never do.

A cut at a field limit may leave a whole sentence, which no trigram betrays. So the
lengths of a source are counted too, in characters and in bytes: a length that far
more families have than its neighbours do, above it above all, is a limit of that source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from axiomill.workspace import Workspace

DEPTH = 6  # last trigrams looked at
RARE, USUAL = 0.0015, 0.004  # share of occurrences that are ends: at most of a cut, at least of a usual end
# of a cut, what that share may be at the most by the upper bound of its 95 % confidence interval; and where the very last trigram decides alone
RARE_BOUND, CERTAIN_BOUND = 0.02, 0.0075
SPIKE = 8  # times the mean of its neighbours, from which a length is a limit
LEAST_SHARE = 0.01  # of a source's families that must have the length of a limit
OF_HIGHEST = 0.2  # a spike below this share of its source's highest is that one's shadow in the other unit
MOST_SLOTS = 1 << 20  # words of 64 bits that the filter of last trigrams has at the most; it has 16 bits a trigram up to there

# runs of letters; of other signs the per cent sign alone is kept, as it stands for a unit: figures go, so they split no counts
TOKENS = r"split(trim(regexp_replace(lower({text}), '[\\x00-\\x24\\x26-\\x60\\x7B-\\x7F\\u00A0\\u2000-\\u206F]+', ' ')), ' ')"
# a text that ends inside a character, an entity, a code or a tag
INSIDE = r"(\\uFFFD|&#?[a-zA-Z0-9]{{1,8}}|\\\\u[0-9a-fA-F]{{0,3}}|<[a-zA-Z/]{{0,8}})$"
MARK = r"(\\.\\.\\.|…|\\[(\\.\\.\\.|…)\\])\\s*$"
CLOSED = r"[.!?*:;][^\\p{{L}}\\p{{N}}]{{0,3}}$"  # a text that a mark closes
WHOLE = 99  # stands for the words of its last sentence, as all of them may show a usual end
TAIL = 300  # characters in which the last words are looked for before the whole text is

# one pass over the texts: lengths, the last characters and the last words, which are those of the whole text
FACTS = f"""
with d as (
  select doc_id, coalesce(source, '') as src, source is not null as has_src, coalesce(family_id, -doc_id) as fam, text, right(text, {TAIL}) as tail
  from {{documents}} where doc_id is not null and text is not null),
t as (
  select doc_id, src, has_src, fam, length(text) as chars, octet_length(text) as bytes, right(tail, 16) as tail,
    {TOKENS.format(text="tail")} as near, text,
    if(rtrim(tail) rlike '{CLOSED}', {WHOLE}, size(filter({TOKENS.format(text="element_at(split(tail, '[.!?]\\\\s+'), -1)")}, x -> x <> ''))) as m from d),
w as (
  select doc_id, src, has_src, fam, chars, bytes, tail, m,
    if(size(near) < {DEPTH + 4} and chars > {TAIL}, {TOKENS.format(text="text")}, near) as w from t)
select doc_id, src, has_src, fam, chars, bytes, tail, m, slice(w, -least({DEPTH + 2}, size(w)), {DEPTH + 2}) as w from w
"""

LAST = """
with e as (
  select doc_id, src, fam, m, w[size(w) - 2] as b1, w[size(w) - 1] as b2,
    explode(transform(sequence(0, size(w) - 3), d -> struct(d, xxhash64(w[size(w) - 3 - d], w[size(w) - 2 - d], w[size(w) - 1 - d]) as tri))) as x
  from {facts} where size(w) >= 3)
select doc_id, src, fam, m, x.d, x.tri, xxhash64(b1, b2) as bi from e
"""

# which trigrams are last ones somewhere: one bit each, in a list as long as there are trigrams
BITS = """
with b as (
  select pmod(tri, {slots} * 64) as h from {{last}} group by 1
  union all select pmod(bi, {slots} * 64) from {{last}} group by 1),
s as (
  select cast(h div 64 as int) as slot, bit_or(shiftleft(1L, cast(h % 64 as int))) as bits from b group by 1
  union all select explode(sequence(0, {slots} - 1)), 0L)
select transform(sort_array(collect_list(struct(slot, bits))), x -> x.bits) as bits from (select slot, bit_or(bits) as bits from s group by slot)
"""

INSIDE_COUNTS = f"""
with w as (select coalesce(source, '') as src, {TOKENS.format(text="text")} as w from {{{{documents}}}} where doc_id is not null and text is not null),
x as (select src, explode(arrays_zip(a, b, c)) as x from (select src, w as a, slice(w, 2, size(w)) as b, slice(w, 3, size(w)) as c from w where size(w) >= 3)),
g as (select src, explode(array(xxhash64(x.a, x.b, x.c), xxhash64(x.a, x.b))) as g from x where x.c is not null)
select src, g, count(*) as n from g
where getbit((select bits from {{{{bits}}}})[cast(pmod(g, {{slots}} * 64) div 64 as int)], cast(pmod(g, {{slots}} * 64) % 64 as int)) = 1
group by src, g
"""

# a trigram is no end: the share of its occurrences that are ends is low, and so many were seen that it can't be high
# (t ends seen, its upper bound by the normal approximation of the Poisson distribution; 3.0 where none was)
NO_END = f"t <= {RARE} * n and t + 1.3 + 1.7 * sqrt(t + 1) <= {{bound}} * n"
USUAL_END = f"(near >= 3 and near >= {USUAL} * n)"
USUAL_IN_SOURCE = "(ts >= 1 and ns >= 10 and ts >= 0.02 * ns)"
EVIDENCE = f"""
with at_src as (select src, tri, d, count(distinct fam) as t from {{last}} group by src, tri, d),
at_all as (select tri, d, count(distinct fam) as t from {{last}} group by tri, d),
ends as (
  select tri, d, t, sum(t) over (partition by tri order by d range between 1 preceding and 1 following) as around from at_all),
in_all as (select g, sum(n) as n from {{inside}} group by g),
j as (
  select l.doc_id, l.m, l.d, n.n, e.t - 1 as t, if(l.d = 0, e.t, if(l.d = 1, e.around - coalesce(z.t, 0), e.around)) - 1 as near,
    i.n as ns, a.t - 1 as ts
  from {{last}} l
  join in_all n on n.g = l.tri
  join {{inside}} i on i.g = l.tri and i.src = l.src
  join ends e on e.tri = l.tri and e.d = l.d
  left join at_all z on z.tri = l.tri and z.d = 0
  join at_src a on a.src = l.src and a.tri = l.tri and a.d = l.d),
k as (
  select doc_id,
    bool_or({NO_END.format(bound=RARE_BOUND)}) as rare_end,
    bool_or(d = 0 and {NO_END.format(bound=CERTAIN_BOUND)}) as certain,
    bool_or(d < m and {USUAL_END}) as usual,
    bool_or(d < m and {USUAL_IN_SOURCE}) as usual_in_source,
    bool_or(m < {WHOLE} and d = 0 and {NO_END.format(bound=RARE_BOUND)} and not {USUAL_END} and not {USUAL_IN_SOURCE}) as unfinished
  from j group by doc_id),
bi_end as (select bi, count(distinct fam) as t from {{last}} where d = 0 group by bi),
b as (
  select l.doc_id, e.t - 1 >= 5 and e.t - 1 >= 0.1 * coalesce(n.n, 0) as closing
  from {{last}} l join bi_end e on e.bi = l.bi left join in_all n on n.g = l.bi where l.d = 0)
select k.doc_id from k join b on b.doc_id = k.doc_id
where not closing and (unfinished or not usual_in_source and (certain or (rare_end and not usual)))
"""

# lengths in characters and bytes, families a length, against the mean of the lengths around it
LIMITS = f"""
with n as (
  select src, unit, l, count(distinct fam) as f
  from (select src, fam, stack(2, 'chars', chars, 'bytes', bytes) as (unit, l) from {{facts}} where has_src and not tail rlike '{MARK}')
  group by src, unit, l),
m as (
  select src, unit, l, f, sum(f) over (partition by src, unit) as total,
    coalesce(sum(f) over (partition by src, unit order by l range between 1 following and 3 following), 0) as above,
    (coalesce(sum(f) over (partition by src, unit order by l range between 20 preceding and 4 preceding), 0)
     + coalesce(sum(f) over (partition by src, unit order by l range between 4 following and 20 following), 0)) / 34.0 as mean
  from n),
s as (
  select src, unit, l, f, max(f) over (partition by src) as highest
  from m where f >= 5 and f >= {LEAST_SHARE} * total and f >= 4 * above and f >= {SPIKE} * greatest(mean, 0.25))
select src, unit, l from s where f >= {OF_HIGHEST} * highest
"""

# texts closed by a mark of omission, where those of their source have nearly one length
MARKED = f"""
with m as (select doc_id, src, fam, chars as l from {{facts}} where has_src and tail rlike '{MARK}'),
c as (select src, l div 16 as slot, count(distinct fam) as f from m group by 1, 2),
a as (
  select src, slot, sum(f) over (partition by src order by slot range between 1 preceding and 1 following) as near, sum(f) over (partition by src) as total from c)
select m.doc_id from m join a on a.src = m.src and a.slot = m.l div 16 where a.near >= 5 and a.near >= 0.2 * a.total
"""

AT_LIMIT = r"""
select d.doc_id from {facts} d join {limits} l on l.src = d.src
where d.has_src and if(l.unit = 'chars', d.chars, d.bytes) = l.l
   or d.has_src and l.unit = 'chars' and d.chars between l.l - 2 and l.l - 1 and not d.tail rlike '[.!?*]\\s*$'
"""


def cut_documents(documents: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(doc_id) of the texts of (doc_id, source, family_id, text) that were cut before their end.

    A row with a null doc_id or text is absent, and so is an empty text, which has no
    end to judge. A null source has no limits of its own, a null family is one of its
    own. Repeated rows are one family and come out once. Very long texts are read
    whole. No documents give no rows.
    """
    spark: SparkSession = documents.sparkSession
    ws = ws or Workspace(spark)
    documents = documents.select("doc_id", "source", "family_id", "text")
    facts = ws.save(spark.sql(FACTS, documents=documents), "facts")
    seen = Observation()
    last = ws.save(spark.sql(LAST, facts=facts).observe(seen, F.count("*").alias("n")), "last")
    slots = min(MOST_SLOTS, 1 << max(10, (seen.get["n"] * 16 // 64).bit_length()))
    bits = ws.save(spark.sql(BITS.format(slots=slots), last=last), "bits")
    inside = ws.save(spark.sql(INSIDE_COUNTS.format(slots=slots), documents=documents, bits=bits), "inside")
    limits = ws.save(spark.sql(LIMITS, facts=facts), "limits")
    parts = [
        spark.sql(EVIDENCE, last=last, inside=inside),
        spark.sql(f"select doc_id from {{facts}} where tail rlike '{INSIDE}'", facts=facts),
        spark.sql(MARKED, facts=facts),
        spark.sql(AT_LIMIT, facts=facts, limits=limits),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def cut_rates(documents: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(source, n_docs, n_cut, cut_rate) for every source, null among them."""
    cut = cut_documents(documents, ws)
    return documents.sparkSession.sql(
        """select source, count(*) as n_docs, count(c.doc_id) as n_cut, count(c.doc_id) / count(*) as cut_rate
           from (select distinct doc_id, source from {documents} where doc_id is not null and text is not null) d left join {cut} c on c.doc_id = d.doc_id group by source""",
        documents=documents.select("doc_id", "source", "text"),
        cut=cut,
    )
