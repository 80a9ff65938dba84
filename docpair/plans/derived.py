"""Documents with sections, dates and requirements, and pairs of them, made of the given tables by joins.

A profile is a customer's: contact lines, a summary, dated entries from orders, a degree, and the names of delivered
parts as skills. A posting is an order's: a title, a place, the parts it asks for in two blocks, years and a degree.
Each posting is paired with its customer's profile. PROFILES, POSTINGS, DICTIONARY and PAIRS are the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEGREES = ["Bachelor of Science in Physics, 1990 - 1994", "Ph.D. in Statistics", "M.S. in Computer Science, graduated with honours", "Associate degree", "High school", "self taught"]


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _joined(key: str, order: list[str], line: Column, sep: str = "\n") -> Column:
    """An aggregate: lines in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), sep).alias(key)


def _choice(n: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the customer's key), text."""
    customer, orders, lineitem, part = _tables(spark, sf_dir, "customer", "orders", "lineitem", "part")
    month = lambda d: F.date_format(d, "MMM yyyy")
    end = F.when(F.col("o_orderstatus") == "O", "Present").otherwise(month(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 700).cast("int"))))
    entry = F.concat(month(F.col("o_orderdate")), F.lit(" - "), end, F.lit(" | "), F.lower(F.expr("substring(o_orderpriority, 3)")), F.lit(" priority clerk\nReduced waste by "), F.col("o_orderkey") % 40, F.lit("% for "), F.col("o_orderkey") % 90, F.lit(" clients."))
    entries = orders.groupBy("o_custkey").agg(_joined("entries", ["o_orderkey"], entry))
    names = lineitem.where("l_linestatus = 'F'").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    names = names.groupBy(F.col("o_custkey").alias("s_custkey"), "p_name").agg(F.min("l_linenumber").alias("n"))
    name = F.col("p_name")
    written = F.when(F.col("n") % 4 == 0, F.upper(name)).when(F.col("n") % 4 == 1, F.replace(name, F.lit(" "), F.lit("-"))).when(F.col("n") % 4 == 2, F.concat(name, F.lit("s"))).otherwise(name)
    skills = names.groupBy("s_custkey").agg(_joined("skills", ["p_name"], written, ", "))
    key = F.col("c_custkey")
    text = F.concat_ws(
        "\n", F.col("c_name"), F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))), F.lit("@mail.example | +1 555 0100 "), F.lpad(key.cast("string"), 4, "0")), F.lit("SUMMARY"),
        F.concat((key % 12 + 1).cast("string"), F.lit("+ years of experience in "), F.lower("c_mktsegment"), F.lit(" work. Led and improved 3 teams.")),
        _choice(key, "WORK EXPERIENCE", "Professional Experience:", "Employment history"), F.coalesce("entries", F.lit("")), F.lit("EDUCATION"), _choice(key, *DEGREES),
        F.lit("Technical Skills & Tools"), F.coalesce("skills", F.lit("")), _choice(key, "Certifications\nCertified fork lift driver", "Awards\nBest clerk", "Experience\nA summer of red bolts"),
    )
    joined = customer.join(entries, key == F.col("o_custkey"), "left").join(skills, key == F.col("s_custkey"), "left")
    return joined.select(key.alias("doc_id"), text.alias("text"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the order's key), text."""
    customer, orders, lineitem, part, nation = _tables(spark, sf_dir, "customer", "orders", "lineitem", "part", "nation")
    lines = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat(F.lit("- "), F.col("p_name"), F.lit(" for "), F.col("l_quantity").cast("int"), F.lit(" users"))
    listed = lambda name, test: _joined(name, ["l_linenumber", "p_name", "l_quantity"], F.when(test, line))
    blocks = lines.groupBy("l_orderkey").agg(listed("must", F.col("l_returnflag") != "A"), listed("nice", F.col("l_returnflag") == "A"))
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    degree = F.when(F.col("o_orderstatus") == "F", "- Bachelor degree in physics required.").when(F.col("o_orderstatus") == "P", "- Master degree or equivalent preferred").otherwise("- Teamwork and clear communication")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Job title: "), F.lower(F.expr("substring(o_orderpriority, 3)")), F.lit(" priority "), F.lower("c_mktsegment"), F.lit(" clerk")),
        F.concat(F.lit("Location: "), F.col("n_name"), F.lit(" | full time employment")), F.concat(F.lit("We look for people with "), F.col("o_orderkey") % 9 + 1, F.lit("+ years of experience.")),
        F.lit("Requirements:"), F.coalesce("must", F.lit("")), degree, F.lit("Nice to have:"), F.coalesce("nice", F.lit("")), F.lit("Benefits"), F.concat(F.lit("- $"), F.floor("o_totalprice").cast("string"), F.lit(" per year and small rings")),
    )
    joined = orders.join(places, F.col("o_custkey") == F.col("c_custkey")).join(blocks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surface, canonical, category, policy (any or exact): names of parts, with their hyphenated form; their nouns, if capitalised."""
    (part,) = _tables(spark, sf_dir, "part")
    names = part.groupBy("p_name").agg(F.lower(F.min("p_type")).alias("category"))
    rows = names.select(F.col("p_name").alias("surface"), F.col("p_name").alias("canonical"), "category", F.lit("any").alias("policy"))
    nouns = names.select(F.element_at(F.split("p_name", " "), -1).alias("noun")).distinct()
    return rows.unionByName(nouns.select(F.col("noun").alias("surface"), F.col("noun").alias("canonical"), F.lit("noun").alias("category"), F.lit("exact").alias("policy")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, left_id (a profile), right_id (a posting)."""
    (orders,) = _tables(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("left_id"), F.col("o_orderkey").alias("right_id"))


def _sql_choice(n: str, *values: str) -> str:
    listed = ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values)
    return f"([{listed}])[{n} % {len(values)} + 1]"


PROFILES = rf"""
entries as (select o_custkey, string_agg(strftime(o_orderdate, '%b %Y') || ' - ' || case when o_orderstatus = 'O' then 'Present' else strftime(o_orderdate::date + (o_orderkey % 700)::int, '%b %Y') end
  || ' | ' || lower(substr(o_orderpriority, 3)) || ' priority clerk' || chr(10) || 'Reduced waste by ' || (o_orderkey % 40) || '% for ' || (o_orderkey % 90) || ' clients.', chr(10) order by o_orderkey) as entries from orders group by o_custkey),
names as (select o_custkey, p_name, min(l_linenumber) as n from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_linestatus = 'F' group by all),
skilled as (select o_custkey, string_agg(case n % 4 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '-') when 2 then p_name || 's' else p_name end, ', ' order by p_name) as skills from names group by o_custkey),
profiles as (select c_custkey as doc_id, c_name || chr(10) || lower(replace(c_name, '#', '')) || '@mail.example | +1 555 0100 ' || lpad(c_custkey::varchar, 4, '0') || chr(10) || 'SUMMARY' || chr(10)
  || (c_custkey % 12 + 1) || '+ years of experience in ' || lower(c_mktsegment) || ' work. Led and improved 3 teams.' || chr(10) || {_sql_choice("c_custkey", "WORK EXPERIENCE", "Professional Experience:", "Employment history")} || chr(10)
  || coalesce(entries, '') || chr(10) || 'EDUCATION' || chr(10) || {_sql_choice("c_custkey", *DEGREES)} || chr(10) || 'Technical Skills & Tools' || chr(10) || coalesce(skills, '') || chr(10)
  || {_sql_choice("c_custkey", "Certifications" + chr(10) + "Certified fork lift driver", "Awards" + chr(10) + "Best clerk", "Experience" + chr(10) + "A summer of red bolts")} as text
  from customer left join entries on c_custkey = entries.o_custkey left join skilled on c_custkey = skilled.o_custkey)"""

POSTINGS = r"""
blocks as (select l_orderkey, string_agg('- ' || p_name || ' for ' || l_quantity::int || ' users', chr(10) order by l_linenumber, p_name, l_quantity) filter (l_returnflag <> 'A') as must,
  string_agg('- ' || p_name || ' for ' || l_quantity::int || ' users', chr(10) order by l_linenumber, p_name, l_quantity) filter (l_returnflag = 'A') as nice from lineitem join part on l_partkey = p_partkey group by l_orderkey),
postings as (select o_orderkey as doc_id, 'Job title: ' || lower(substr(o_orderpriority, 3)) || ' priority ' || lower(c_mktsegment) || ' clerk' || chr(10) || 'Location: ' || n_name || ' | full time employment' || chr(10)
  || 'We look for people with ' || (o_orderkey % 9 + 1) || '+ years of experience.' || chr(10) || 'Requirements:' || chr(10) || coalesce(must, '') || chr(10)
  || case o_orderstatus when 'F' then '- Bachelor degree in physics required.' when 'P' then '- Master degree or equivalent preferred' else '- Teamwork and clear communication' end || chr(10)
  || 'Nice to have:' || chr(10) || coalesce(nice, '') || chr(10) || 'Benefits' || chr(10) || '- $' || floor(o_totalprice)::bigint || ' per year and small rings' as text
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join blocks on o_orderkey = l_orderkey)"""

DICTIONARY = """
named as (select p_name, lower(min(p_type)) as category from part group by p_name),
dictionary as (select p_name as surface, p_name as canonical, category, 'any' as policy from named
  union all select distinct string_split(p_name, ' ')[-1], string_split(p_name, ' ')[-1], 'noun', 'exact' from named)"""

PAIRS = "pairs as (select o_orderkey as pair_id, o_custkey as left_id, o_orderkey as right_id from orders)"
