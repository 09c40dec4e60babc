"""Online views: search, display, relations, risks and the response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.plans.cases import RANKED, ranked_items
from caselode.plans.registry import query
from caselode.sources.tables import table

SEARCH = """CASE WHEN lower(trim(p_name)) = '{q}' THEN 0 WHEN p_partkey::VARCHAR = '{q}' THEN 1 WHEN starts_with(lower(trim(p_name)), '{q}') THEN 2
WHEN starts_with(p_partkey::VARCHAR, '{q}') THEN 3 WHEN contains(lower(trim(p_name)), '{q}') THEN 4 WHEN contains(p_partkey::VARCHAR, '{q}') THEN 5 END"""


def search_category(name: str, number: str, wanted: str) -> Column:
    """0 to 5: equal, beginning, holding, name before number each time; null where nothing matches or the query is blank."""
    q, n, k = F.lit(wanted.strip().lower()), T.normalize(name), T.strip(F.coalesce(F.col(number).cast("string"), F.lit("")))
    number_ = lambda test: (k != "") & test
    tests = [n == q, number_(k == q), n.startswith(q), number_(k.startswith(q)), n.contains(q), number_(k.contains(q))]
    out = F.lit(None).cast("int")
    for i, test in reversed(list(enumerate(tests))):
        out = F.when(test, i).otherwise(out)
    return F.when(q != "", out)


@query("WITH c AS (SELECT p_partkey, p_name, p_brand, " + SEARCH.format(q="12") + " AS category FROM part) SELECT p_partkey, p_name, category FROM c WHERE category IS NOT NULL ORDER BY category, p_name, coalesce(p_brand, ''), p_partkey LIMIT 20")
def drug_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 of a name or number search."""
    found = table(spark, sf_dir, "part").withColumn("category", search_category("p_name", "p_partkey", "12")).filter("category is not null")
    return found.orderBy("category", "p_name", F.coalesce("p_brand", F.lit("")), "p_partkey").limit(20).select("p_partkey", "p_name", "category")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY lower(trim(p_type))) AS same_name_count FROM part")
def same_name_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a normalised name; counts are joined back rather than windowed, so a hot name isn't gathered."""
    named = table(spark, sf_dir, "part").select("p_partkey", T.normalize("p_type").alias("_n"))
    return named.join(named.groupBy("_n").agg(F.count("*").alias("same_name_count")), "_n").select("p_partkey", "same_name_count")


@query(f"""WITH {RANKED}, t AS (SELECT case_id, p_type, min(rank) AS r FROM rk JOIN part ON drug_id = p_partkey GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY r) AS k FROM t)
SELECT case_id, array_to_string(list(p_type ORDER BY r) FILTER (k <= 3), '、') AS summary FROM o GROUP BY 1""")
def treat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three different treatments of a case."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), "p_type")
    x = ranked_items(spark, sf_dir).join(parts, "drug_id").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_type"))), lambda v: v["p_type"]).alias("t"))
    kept = F.slice(F.array_distinct(T.filled(F.col("t"))), 1, 3)
    return x.select("case_id", F.when(F.size(kept) > 0, F.array_join(kept, "、")).otherwise("None").alias("summary"))


@query("""SELECT p_partkey AS drug_id, unnest(['treat', 'ingredient', 'interaction']) AS predicate, unnest([p_type, p_brand, p_name]) AS object FROM part""")
def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per relation of a catalogue entry; blank objects are left out."""
    rows = F.array(*[F.struct(F.lit(p).alias("predicate"), T.strip(c).alias("object")) for p, c in (("treat", "p_type"), ("ingredient", "p_brand"), ("interaction", "p_name"))])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), F.inline(rows)).filter("object is not null and object != ''")


@query(f"""WITH {RANKED}, x AS (SELECT case_id, rank, p_type, p_brand FROM rk JOIN part ON drug_id = p_partkey),
h AS (SELECT DISTINCT case_id, p_brand FROM x WHERE rank > 3)
SELECT x.case_id, count(*) AS conflicts, array_to_string(list(DISTINCT x.p_brand ORDER BY x.p_brand), ',') AS names FROM x JOIN h ON x.case_id = h.case_id AND x.p_brand = h.p_brand WHERE x.rank <= 3 GROUP BY 1""")
def risk_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected entries whose ingredient interacts by name with what the case takes."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), "p_brand")
    x = ranked_items(spark, sf_dir).join(parts, "drug_id").groupBy("case_id").agg(F.collect_list(F.when(F.col("rank") <= 3, F.col("p_brand"))).alias("chosen"), F.collect_set(F.when(F.col("rank") > 3, F.col("p_brand"))).alias("taken"))
    bad = F.filter("chosen", lambda b: F.array_contains("taken", b))
    return x.select("case_id", F.size(bad).cast("long").alias("conflicts"), F.array_join(F.sort_array(F.array_distinct(bad)), ",").alias("names")).filter("conflicts > 0")


@query(f"""WITH {RANKED}, ev AS (SELECT case_id, rank, 'retrieval::' || drug_id || '::treat' AS evidence_id FROM rk)
SELECT case_id, evidence_id FROM ev WHERE EXISTS (SELECT 1 FROM ev u WHERE u.case_id = ev.case_id AND u.evidence_id = ev.evidence_id AND u.rank <= 2)""")
def evidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidences that a case's answer refers to."""
    ev = ranked_items(spark, sf_dir).select("case_id", "rank", F.concat(F.lit("retrieval::"), "drug_id", F.lit("::treat")).alias("evidence_id"))
    return ev.join(ev.filter("rank <= 2").select("case_id", "evidence_id"), ["case_id", "evidence_id"], "left_semi").select("case_id", "evidence_id")


@query()
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response of each case as JSON, nulls kept."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), "p_name", "p_brand")
    x = ranked_items(spark, sf_dir).filter("rank <= 10").join(parts, "drug_id")
    held = x.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("drug_id").alias("drugid"), F.col("p_name").alias("name"), F.col("p_brand").alias("maker")))).alias("candidates"))
    return held.select("case_id", F.to_json(F.struct("case_id", "candidates", F.size("candidates").alias("total")), {"ignoreNullFields": "false"}).alias("response"))


@query(f"""WITH {RANKED} SELECT rk.case_id, rk.drug_id, p_name AS name FROM rk LEFT JOIN part ON drug_id = p_partkey WHERE rank = 1""")
def resolve_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a case takes, resolved against the catalogue; an unknown id is an error."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), F.col("p_name").alias("name"))
    x = ranked_items(spark, sf_dir).filter("rank = 1").join(parts, "drug_id", "left")
    return x.select("case_id", "drug_id", F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("unknown id "), "drug_id"))).otherwise(F.col("name")).alias("name"))


@query("SELECT user_id, event_type, count(*) AS steps, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def timing_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage timings and their total."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("steps"), F.round(F.sum("value"), 6).alias("total"))
