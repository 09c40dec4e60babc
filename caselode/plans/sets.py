"""Set scoring: unit vectors, attention over a set, cosine to all items, threshold metrics, losses and pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import retrieval
from caselode.operators import scorers as S

from caselode.plans.encoding import batch_similar_index
from caselode.plans.evaluation import HITS, _hits
from caselode.plans.registry import ORACLES, query
from caselode.sources.tables import case_symptoms, table

#: Weights of the attention, repeated over all components.
WEIGHTS = (0.5, -1.0, 0.25, 1.0)
VECTORS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT vec_id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
w AS (SELECT i, CASE i % 4 WHEN 1 THEN 0.5 WHEN 2 THEN -1.0 WHEN 3 THEN 0.25 ELSE 1.0 END AS w FROM (SELECT DISTINCT i FROM c) d)"""
SETS = VECTORS + """, s AS (SELECT s_nationkey AS set_id, s_suppkey AS vec_id FROM supplier), a AS (SELECT vec_id, exp(tanh(sum(w * x))) AS e FROM c JOIN w USING (i) GROUP BY 1),
p AS (SELECT set_id, i, sum(e * x) / sum(e) AS x FROM s JOIN a USING (vec_id) JOIN c USING (vec_id) GROUP BY 1, 2),
n AS (SELECT set_id, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY set_id)), 1e-12) AS x FROM p)"""


def unit(v: Column | str) -> Column:
    """A vector over its length, which counts as 1e-12 at least."""
    norm = F.greatest(F.sqrt(S.dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return v, v.agg(F.max(F.size("v"))).first()[0] or 0


def set_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, v): a nation's suppliers as a set, softmax of tanh(w.e) as weights, then unit length."""
    v, dims = _vectors(spark, sf_dir)
    weights = F.array(*[F.lit(WEIGHTS[i % len(WEIGHTS)]) for i in range(dims)])
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("set_id"), F.col("s_suppkey").alias("vec_id"))
    rows = members.join(v, "vec_id").withColumn("a", F.tanh(S.dot(weights, "v")))
    return S.attention_pool(rows, "set_id", "a", "v").select("set_id", unit("pooled").alias("v"))


def _components(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("v").alias("_i", "_x")).select(key, (F.col("_i") + 1).cast("long").alias("component"), F.round("_x", 6).alias("value"))


@query(f"WITH {VECTORS} SELECT vec_id, i AS component, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 6) AS value FROM c")
def unit_item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(_vectors(spark, sf_dir)[0].select("vec_id", unit("v").alias("v")), "vec_id")


@query(f"WITH {SETS} SELECT set_id, i AS component, round(x, 6) AS value FROM n")
def set_attention_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(set_vectors(spark, sf_dir), "set_id")


@query(f"""WITH {SETS}, l AS (SELECT vec_id, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) AS x FROM c),
d AS (SELECT set_id, vec_id, round(sum(n.x * l.x), 6) AS z FROM n JOIN l USING (i) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY z DESC, vec_id) AS rank FROM d)
SELECT set_id, vec_id, rank, round(1 / (1 + exp(-greatest(-10.0, least(10.0, z)))), 6) AS probability FROM r WHERE rank <= 5""")
def set_item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest of all items for each set: cosine, held to 10 either way, as a probability."""
    sets = set_vectors(spark, sf_dir).select(F.col("set_id").alias("query_id"), F.col("v").alias("qv"))
    items = _vectors(spark, sf_dir)[0].select(F.col("vec_id").alias("doc_id"), "v")
    p = S.sigmoid(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("score"))))
    return retrieval.dense_topk(sets, items, 5).select(F.col("query_id").alias("set_id"), F.col("doc_id").alias("vec_id"), "rank", F.round(p, 6).alias("probability"))


LIKELY = VECTORS + ", y AS (SELECT vec_id, i, 1 / (1 + exp(-10 * x)) >= 0.8 AS predicted, i % 10 = label AS gold FROM c)"


def likely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, item, predicted, gold): a row's components are its items' logits; those of 0.8 or more are predicted."""
    c = _vectors(spark, sf_dir)[0].select("vec_id", "label", F.posexplode("v").alias("_i", "_x"))
    item = (F.col("_i") + 1).cast("long")
    return c.select("vec_id", item.alias("item"), (S.sigmoid(10 * F.col("_x")) >= 0.8).alias("predicted"), (item % 10 == F.col("label")).alias("gold"))


@query(f"""WITH {LIKELY}, m AS (SELECT vec_id, count(*) FILTER (predicted) AS p, count(*) FILTER (gold) AS g, count(*) FILTER (predicted AND gold) AS h FROM y GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN p + g - h > 0 THEN h / (p + g - h) ELSE 0.0 END), 6) AS ja, round(avg(CASE WHEN p > 0 THEN h / p ELSE 0.0 END), 6) AS precision, round(avg(CASE WHEN g > 0 THEN h / g ELSE 0.0 END), 6) AS recall,
 round(avg(CASE WHEN p + g > 0 THEN 2 * h / (p + g) ELSE 0.0 END), 6) AS f1, round(avg(p), 6) AS avg_drugs FROM m""")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over rows of Jaccard, precision, recall, F1 and predicted items, over all components."""
    m = likely(spark, sf_dir).groupBy("vec_id").agg(F.count_if("predicted").alias("p"), F.count_if("gold").alias("g"), F.count_if(F.col("predicted") & F.col("gold")).alias("h"))
    p, g, h = F.col("p"), F.col("g"), F.col("h")
    means = {"ja": T.divide(h, p + g - h), "precision": T.divide(h, p), "recall": T.divide(h, g), "f1": T.divide(2 * h, p + g), "avg_drugs": p}
    return m.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(k) for k, c in means.items()])


@query(f"""WITH {LIKELY}, x AS (SELECT a.vec_id, count(*) AS pairs FROM y a JOIN y b ON a.vec_id = b.vec_id AND abs(a.i - b.i) = 1 WHERE a.predicted AND b.predicted GROUP BY 1)
SELECT v.vec_id, coalesce(pairs, 0) / 2 AS pairs FROM v LEFT JOIN x USING (vec_id)""")
def interaction_regulariser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of p'Ap of each row's predicted items over the interaction edges, here between neighbouring numbers."""
    chosen = likely(spark, sf_dir).filter("predicted").select("vec_id", "item")
    edges = F.explode(F.array(F.col("item") - 1, F.col("item") + 1)).alias("item")
    hit = chosen.select("vec_id", edges).join(chosen, ["vec_id", "item"]).groupBy("vec_id").agg((F.count("*") / 2).alias("pairs"))
    return table(spark, sf_dir, "embeddings").select("vec_id").join(hit, "vec_id", "left").fillna(0.0, ["pairs"])


@query(f"""WITH {VECTORS}, b AS (SELECT vec_id, label, avg(greatest(x, 0) - x * (i % 10 = label)::INT + ln(1 + exp(-abs(x)))) AS loss, arg_min(i, {{'s': -round(x, 6), 'i': i}}) % 10 = label AS hit FROM c GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg(loss), 6) AS loss, round(avg(hit::INT), 6) AS hit FROM b GROUP BY 1""")
def loss_with_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss beside the mean of a metric: whether the likeliest item is a right one."""
    c = _vectors(spark, sf_dir)[0].select("vec_id", "label", F.posexplode("v").alias("_i", "x")).withColumn("item", F.col("_i") + 1)
    gold = (F.col("item") % 10 == F.col("label")).cast("double")
    first = F.min_by("item", F.struct((-F.round("x", 6)).alias("s"), F.col("item").alias("i")))
    per = c.groupBy("vec_id", "label").agg(F.avg(S.bce_with_logits(F.col("x"), gold)).alias("loss"), (first % 10 == F.col("label")).cast("int").alias("hit"))
    return per.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("hit"), 6).alias("hit"))


@query(f"WITH {VECTORS} SELECT label AS graph, i AS component, round(avg(x), 6) AS value FROM c GROUP BY 1, 2")
def graph_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the vectors of a graph's nodes, by component."""
    v, _ = _vectors(spark, sf_dir)
    c = v.select("label", F.posexplode("v").alias("_i", "_x"))
    return c.groupBy(F.col("label").alias("graph"), (F.col("_i") + 1).cast("long").alias("component")).agg(F.round(F.avg("_x"), 6).alias("value"))


@query(f"""WITH {VECTORS}, z AS (SELECT vec_id, label, i, exp(x) / sum(exp(x)) FILTER (i % 10 <> label) OVER (PARTITION BY vec_id) AS a FROM c)
SELECT vec_id, i AS item, CASE WHEN i % 10 = label THEN 0.0 ELSE round(a, 6) END AS attention FROM z""")
def masked_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of a row's scores over its unmasked places; masked ones get nothing."""
    v, _ = _vectors(spark, sf_dir)
    open_ = F.transform("v", lambda x, i: F.when((i + 1) % 10 == F.col("label"), 0.0).otherwise(F.exp(x)))
    rows = v.select("vec_id", open_.alias("e")).withColumn("z", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    held = rows.select("vec_id", "z", F.posexplode("e").alias("_i", "_e"))
    return held.select("vec_id", (F.col("_i") + 1).cast("long").alias("item"), F.round(T.divide(F.col("_e"), F.col("z")), 6).alias("attention"))


@query(f"WITH {HITS} SELECT case_id, bool_or(gold)::INT AS present FROM hit GROUP BY 1")
def answer_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any right item is in the whole list."""
    return _hits(spark, sf_dir).groupBy("case_id").agg(F.max(F.col("gold").cast("int")).alias("present"))


@query(f"""WITH sim AS ({ORACLES["batch_similar_index"]}), y AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS w FROM lineitem),
k AS (SELECT sim.case_id, a.w FROM sim JOIN y a ON a.case_id = sim.case_id JOIN y b ON b.case_id = sim.similar AND b.w = a.w)
SELECT sim.case_id, sim.similar, (SELECT count(*) FROM k WHERE k.case_id = sim.case_id) AS common FROM sim""")
def common_symptoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symptoms a case shares with the similar one of its batch."""
    sets = case_symptoms(spark, sf_dir).groupBy("case_id").agg(F.collect_set("symptom").alias("s"))
    near = batch_similar_index(spark, sf_dir).join(sets, "case_id").join(sets.select(F.col("case_id").alias("similar"), F.col("s").alias("o")), "similar")
    return near.select("case_id", "similar", F.size(F.array_intersect("s", "o")).cast("long").alias("common"))


@query("""WITH t AS (SELECT l_suppkey AS symptom, l_orderkey AS case_id FROM lineitem GROUP BY 1, 2)
SELECT symptom, count(*) AS cases, min(case_id) AS first, max(case_id) AS last FROM t GROUP BY 1""")
def transposed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-hot rows by column: how many cases have a symptom, the first and the last."""
    return case_symptoms(spark, sf_dir).groupBy("symptom").agg(F.count("*").alias("cases"), F.min("case_id").alias("first"), F.max("case_id").alias("last"))
