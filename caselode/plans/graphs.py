"""Graph tables: bounded paths, co-occurrence, bipartite evidence and admission graphs as edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.plans.cases import RANKED
from caselode.plans.registry import query
from caselode.sources.tables import case_diagnoses, case_symptoms, table

EDGES = """e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) edges: suppliers and customers to nations, nations to regions."""
    edge = lambda t, a, b, x, y: table(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return edge("supplier", "s", "n", "s_suppkey", "s_nationkey").unionByName(edge("customer", "c", "n", "c_custkey", "c_nationkey")).unionByName(edge("nation", "n", "r", "n_nationkey", "n_regionkey"))


def bounded_paths(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) over 0 to ``depth`` edges, unrolled; the start itself counts at depth 0."""
    now = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    whole = now
    for d in range(1, depth + 1):
        now = now.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(d).alias("depth"))
        whole = whole.unionByName(now)
    return whole


@query(f"""WITH {EDGES}, p0 AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS depth FROM supplier), p1 AS (SELECT start, dst AS node, 1 AS depth FROM p0 JOIN e ON node = src),
p2 AS (SELECT start, dst AS node, 2 AS depth FROM p1 JOIN e ON node = src) SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2""")
def kg_bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return bounded_paths(starts, kg_edges(spark, sf_dir), 2)


@query("""
SELECT r_name AS region, array_to_string(list(DISTINCT n_name ORDER BY n_name), '|') AS nations, count(DISTINCT s_suppkey) AS suppliers
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def kg_nested_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional matches collected distinct under their start."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    per = s.groupBy("s_nationkey").agg(F.count("*").alias("k"))
    x = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(per, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return x.groupBy(F.col("r_name").alias("region")).agg(F.array_join(F.sort_array(F.collect_set("n_name")), "|").alias("nations"), F.coalesce(F.sum("k"), F.lit(0).cast("long")).alias("suppliers"))


def _pairs(rows: DataFrame, case: str, item: str) -> DataFrame:
    """Distinct (i, j), i < j, of items that share a case; the few items of a case are paired inside its row."""
    held = rows.groupBy(case).agg(F.sort_array(F.collect_set(item)).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.filter("x", lambda b: b > a), lambda b: F.struct(a.alias("i"), b.alias("j")))))
    return held.select(F.inline(pairs)).distinct()


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS case_id, p_brand AS w FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT DISTINCT a.w AS i, b.w AS j FROM d a JOIN d b ON a.case_id = b.case_id AND a.w < b.w) SELECT i, j FROM p UNION ALL SELECT j, i FROM p""")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric co-occurrence, each edge both ways."""
    p = _pairs(case_diagnoses(spark, sf_dir), "case_id", "diagnosis")
    return p.unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j")))


@query("SELECT DISTINCT l_suppkey AS symptom, p_brand AS diagnosis FROM lineitem JOIN part ON l_partkey = p_partkey")
def bipartite_adj(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("symptom"), F.col("p_brand").alias("diagnosis")).distinct()


#: Rows of a task where cases are brought together: what a task holds does not grow with the table.
TASK_ROWS = 500_000


def by_case(rows: DataFrame, lines: DataFrame, case: str = "case_id") -> DataFrame:
    """``rows``, about as many as ``lines``, with those of a case together."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, -(-lines.count() // TASK_ROWS)), case)


@query(f"""WITH {RANKED}, e AS (SELECT DISTINCT case_id, drug_id, p_type AS col FROM rk JOIN part ON drug_id = p_partkey)
SELECT case_id, drug_id, col, round(1.0 / count(*) OVER (PARTITION BY case_id, col), 6) AS w FROM e""")
def adj_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's adjacency, columns summing to 1."""
    # A column's few items are held in its row: ranks aren't needed, and no window sorts what was made distinct.
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), F.col("p_type").alias("col"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("drug_id")).join(parts, "drug_id")
    held = by_case(lines, table(spark, sf_dir, "lineitem")).groupBy("case_id", "col").agg(F.collect_set("drug_id").alias("x"))
    return held.select("case_id", F.explode("x").alias("drug_id"), "col", F.round(1.0 / F.size("x"), 6).alias("w"))


@query(f"""WITH {RANKED}, a AS (SELECT case_id, drug_id, rank, unnest([p_type, p_brand]) AS label, unnest([1, 2]) AS pos FROM rk JOIN part ON drug_id = p_partkey),
f AS (SELECT case_id, label, min(rank * 10 + pos) AS first FROM a GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY first, label) AS idx FROM f)
SELECT a.case_id, a.drug_id, k.idx, a.label FROM (SELECT DISTINCT case_id, drug_id, label FROM a) a JOIN k ON a.case_id = k.case_id AND a.label = k.label WHERE idx <= 5""")
def entity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities numbered as first seen, at most five a case; edges to later ones go."""
    # Labels first, then all of a case together: ranks, labels and caps need no other shuffle.  Items of one line and number rank alike.
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), "p_type", "p_brand", F.lit(True).alias("known"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("drug_id"), "l_linenumber")
    items = by_case(lines.join(parts, "drug_id", "left"), table(spark, sf_dir, "lineitem")).groupBy("case_id", "drug_id", "p_type", "p_brand", "known").agg(F.min("l_linenumber").alias("first_line"))
    ranked = items.withColumn("rank", F.dense_rank().over(Window.partitionBy("case_id").orderBy("first_line", "drug_id")))
    a = ranked.filter("known").select("case_id", "drug_id", "rank", F.posexplode(F.array("p_type", "p_brand")).alias("pos", "label"))
    first = a.groupBy("case_id", "label").agg(F.min(F.struct("rank", "pos")).alias("first"), F.collect_set("drug_id").alias("drugs"))
    capped = first.withColumn("idx", F.row_number().over(Window.partitionBy("case_id").orderBy("first", "label"))).filter("idx <= 5")
    return capped.select("case_id", F.explode("drugs").alias("drug_id"), "idx", "label")


CLINICAL = """g AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, 0 AS rel FROM lineitem UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 1 FROM lineitem
UNION ALL SELECT DISTINCT o_custkey, l_partkey, 2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT DISTINCT l_partkey, o_custkey, 3 FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    a = li.select(F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y")).distinct()
    b = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("x"), F.col("l_partkey").alias("y")).distinct()
    both = lambda e, r: e.select(F.inline(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit(r).alias("rel")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst"), F.lit(r + 1).alias("rel")))))
    return both(a, 0).unionByName(both(b, 2))


@query(f"WITH {CLINICAL} SELECT rel, count(*) AS edges, count(DISTINCT src) AS sources, min(dst) AS least FROM g GROUP BY 1")
def clinical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four global relations and their sizes."""
    per = clinical(spark, sf_dir).groupBy("rel", "src").agg(F.count("*").alias("k"), F.min("dst").alias("d"))
    return per.groupBy("rel").agg(F.sum("k").alias("edges"), F.count("*").alias("sources"), F.min("d").alias("least"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS node FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS node FROM lineitem)
SELECT case_id, 0 AS src, node AS dst, 3 AS rel FROM m UNION ALL SELECT case_id, node, 0, 9 FROM m UNION ALL SELECT case_id, 0, node, 5 FROM s UNION ALL SELECT case_id, node, 0, 11 FROM s""")
def admission_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's own relations, each forward and reverse."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("node")).distinct().withColumn("f", F.lit(3))
    s = case_symptoms(spark, sf_dir).select("case_id", F.col("symptom").alias("node")).withColumn("f", F.lit(5))
    zero = F.lit(0).cast("long")
    edges = F.array(F.struct(zero.alias("src"), F.col("node").alias("dst"), F.col("f").alias("rel")), F.struct(F.col("node").alias("src"), zero.alias("dst"), (F.col("f") + 6).alias("rel")))
    return m.unionByName(s).select("case_id", F.inline(edges))


@query(f"WITH {EDGES} SELECT src, dst FROM e WHERE src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def edge_semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose source is among a case's nodes."""
    keep = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("s"), "s_suppkey").alias("src"))
    return kg_edges(spark, sf_dir).join(keep, "src", "left_semi")
