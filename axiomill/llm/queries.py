"""The queries of the operators for training data, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.core_queries import nt, table
from axiomill.functions.terms import same_term
from axiomill.llm.groups import match_groups
from axiomill.llm.history import repeats
from axiomill.llm.leaks import leaks, without_leaks
from axiomill.llm.mixing import mix
from axiomill.llm.truncation import cut_documents, cut_rates


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "same_links").where(same_term("p") == "owl:sameAs")
    return match_groups(links, "s", "o")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "accepted"), table(spark, sf_dir, "arrivals"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the leaked spans."""
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_documents(table(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p1_found": p1_found, "p7_found": p7_found, "p8_found": p8_found, "p8_cleaned": p8_cleaned, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_rates": p10_rates}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
with recursive l as (select distinct {nt("s")} a, {nt("o")} b from same_links where {nt("p")} = 'owl:sameAs'),
e as (select a, b from l where a is not null and b is not null union select b, a from l where a is not null and b is not null),
r as (select a x, a y from e union select r.x, e.b from r join e on r.y = e.a)
select x term, min(y) group_id from r group by x"""
    }
