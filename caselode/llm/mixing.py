"""Mixing sources to target weights by hierarchical budgeting (operator 8).

Weights go down a domain - language - source tree.  A node's budget is shared among its children by weight; a child that
holds less than its share leaves the shortage to its siblings, and only what a whole subtree cannot hold goes up to the
subtree's own siblings.  A leaf may be read for up to ``max_epochs`` epochs.  Its budget is met by whole epochs and a
token-prefix of one more, in which documents stand in an order seeded by the epoch.

Prefixes need running sums, and one leaf may hold a third of all rows.  So each leaf's order is cut into ``BUCKETS`` by
hash; sums per bucket, combined before the shuffle, give the one bucket per leaf and epoch in which a budget ends, and only
that is ordered row by row.  Budgets are worked out by grouped steps too, so the number of leaves has no cap.

A prefix ends before the document that would pass its budget, so a leaf leaves a remainder.  Remainders go to the siblings
with the most room, then to the leaves of the domain, then to all: what is missing in the end is less than the next document
of the last leaf that was topped up.

Defined results: null and empty texts have no tokens and are in each epoch's prefix up to its end; null domains, languages
or sources are leaves of their own; repeated rows are separate documents; leaves without a weight get ``default_weight``; an
empty table gives no rows; further columns are passed, but for ``mix_*`` of the names added here, which are replaced.
"""

from __future__ import annotations

import functools
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselode.llm.common import table, written

BUCKETS = 1024
LEVELS = ("_domain", "_language", "_source")
#: Leaf rows sent to every executor at most.
BROADCAST_ROWS = 100_000


def share(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Split by weight, no child past its room; shortages go to the other children until none has room."""
    got, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if got[i] + left * weights[i] / total >= room[i] - 1e-9]
        if not full:
            for i in open_:
                got[i] += left * weights[i] / total
            break
        for i in full:  # a filled child takes its room; the rest is split anew
            left -= room[i] - got[i]
            got[i] = room[i]
        filled = set(full)
        open_ = [i for i in open_ if i not in filled]
    return got


def budgets(leaves: dict[tuple, int], target: int, weights: dict[tuple, float], max_epochs: int, default_weight: float = 1.0) -> dict[tuple, int]:
    """Tokens to take from each leaf of a small tree, on the driver: what ``planned`` does for trees of any size.

    ``weights`` holds any node by its path: (domain,), (domain, language) or a leaf.
    """
    room: dict[tuple, float] = defaultdict(float)
    children: dict[tuple, dict[tuple, None]] = defaultdict(dict)
    for leaf in sorted(leaves, key=str):
        for depth in range(len(leaf) + 1):
            room[leaf[:depth]] += leaves[leaf] * max_epochs
            if depth < len(leaf):
                children[leaf[:depth]][leaf[: depth + 1]] = None
    out: dict[tuple, int] = {}

    def down(node: tuple, budget: float) -> None:
        if len(node) == len(LEVELS):
            out[node] = int(budget + 1e-6)
            return
        below = list(children[node])
        for child, part in zip(below, share(budget, [weights.get(c, default_weight) for c in below], [room[c] for c in below]), strict=True):
            down(child, part)

    if leaves:
        down((), target)
    return out


def _same(columns: tuple[str, ...]) -> Column:
    """Equal paths in ``l`` and ``r``, null nodes included; the root's path is empty."""
    return functools.reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns], F.lit(True))


def planned(leaves: DataFrame, target_share: float, weights: dict[tuple, float], max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """(levels, t, _take, _full, _rest): tokens to take from each leaf of (levels, t).

    Each level is a few grouped steps.  Siblings by room over weight: those that fill up come first, and the running sums of
    room and weight tell where they end.  Siblings of one ratio are added up before, so a parent's run has a row for each
    different ratio: with one weight at most sqrt(2 x tokens), however many leaves.
    """
    spark = leaves.sparkSession
    total = leaves.agg(F.sum("t")).first()[0] or 0
    given = None
    for depth in range(1, len(LEVELS) + 1):
        parent, path = LEVELS[: depth - 1], LEVELS[:depth]
        nodes = leaves.groupBy(*path).agg((F.sum("t") * max_epochs).cast("double").alias("_room"))
        known = spark.createDataFrame([(*k, float(w)) for k, w in weights.items() if len(k) == depth], ", ".join(f"{c} string" for c in path) + ", _weight double")
        known = F.broadcast(known) if len(weights) <= BROADCAST_ROWS else known
        nodes = nodes.alias("l").join(known.alias("r"), _same(path), "left").select("l.*", F.coalesce("r._weight", F.lit(float(default_weight))).alias("_weight"))
        open_ = (F.col("_weight") > 0) & (F.col("_room") > 0)
        ratios = nodes.filter(open_).groupBy(*parent, (F.col("_room") / F.col("_weight")).alias("_ratio")).agg(F.sum("_room").alias("_room"), F.sum("_weight").alias("_weight"))
        if given is None:
            ratios = ratios.withColumn("_budget", F.lit(float(int(total * target_share))))
        else:
            ratios = ratios.alias("l").join(given.alias("r"), _same(parent)).select("l.*", "r._budget")
        up = Window.partitionBy(*parent).orderBy("_ratio").rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(*parent).orderBy(F.desc("_ratio")).rowsBetween(Window.unboundedPreceding, 0)
        filled = F.coalesce(F.sum("_room").over(up), F.lit(0.0)) + F.col("_ratio") * F.sum("_weight").over(down) <= F.col("_budget") + 1e-9
        ends = ratios.withColumn("_filled", filled).groupBy(*parent).agg(
            F.first("_budget").alias("_budget"), F.coalesce(F.sum(F.when(F.col("_filled"), F.col("_room"))), F.lit(0.0)).alias("_taken"), F.sum(F.when(~F.col("_filled"), F.col("_weight"))).alias("_open")
        )
        # Tokens for one unit of weight; null where every child is full.
        ends = ends.select(*parent, ((F.col("_budget") - F.col("_taken")) / F.col("_open")).alias("_unit"), F.lit(True).alias("_any"))
        part = F.when(F.col("_any") & open_, F.when(F.col("_unit").isNull(), F.col("_room")).otherwise(F.least("_room", F.greatest("_unit", F.lit(0.0)) * F.col("_weight")))).otherwise(0.0)
        given = nodes.alias("l").join(ends.alias("r"), _same(parent), "left").select("l.*", "r._unit", "r._any").select(*path, part.alias("_budget"))
        given = written(given, "budgets")
    take = F.floor(F.col("_budget") + 1e-6)
    taken = leaves.alias("l").join(given.alias("r"), _same(LEVELS)).select("l.*", take.alias("_take"))
    return epochs(taken.select(*LEVELS, "t", "_take"))


def epochs(plan: DataFrame) -> DataFrame:
    """(levels, t, _take, _full, _rest): the plan's whole epochs, and tokens of one more."""
    full = F.when(F.col("t") > 0, F.expr("_take div t")).otherwise(F.lit(0).cast("long"))
    return plan.withColumn("_full", full).withColumn("_rest", F.col("_take") - F.col("_full") * F.col("t"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _joined(rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    return rows.alias("l").join(plan.alias("r"), _same(LEVELS)).select("l.*", *[f"r.{c}" for c in columns])


def _ordered(sized: DataFrame, plan: DataFrame, seed: int, *columns: str) -> DataFrame:
    """Rows with their place ``_order`` in the epoch that the plan cuts, and its bucket."""
    order = F.xxhash64(F.lit(seed), F.col("_full"), "_row")
    return _joined(sized, plan, "_full", "_rest", *columns).withColumn("_order", order).withColumn("_bucket", F.shiftrightunsigned("_order", 54).cast("int"))


def _edges(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The plan with the bucket ``_edge`` in which each leaf's prefix ends, and the tokens ``_before`` it."""
    sums = _ordered(sized, plan, seed).groupBy(*LEVELS, "_bucket").agg(F.sum("mix_tokens").alias("n"), F.first("_rest").alias("_rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ends = sums.withColumn("_before", before).filter("_before + n > _rest").groupBy(*LEVELS).agg(F.min(F.struct("_bucket", "_before")).alias("e"))
    found = plan.alias("l").join(ends.alias("r"), _same(LEVELS), "left")
    return written(found.select("l.*", F.coalesce("r.e._bucket", F.lit(BUCKETS)).alias("_edge"), F.coalesce("r.e._before", F.lit(0).cast("long")).alias("_before")), "edges")


def _prefix(rows: DataFrame) -> DataFrame:
    """Of the rows in edge buckets, those inside the prefix, with ``_run``: the tokens up to and with each."""
    edge = rows.filter("_bucket = _edge and _rest > 0")
    run = F.sum("mix_tokens").over(Window.partitionBy(*LEVELS).orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, 0))
    return edge.withColumn("_run", run + F.col("_before")).filter("_run <= _rest")


def _topped_up(sized: DataFrame, plan: DataFrame, depth: int, max_epochs: int, seed: int) -> DataFrame:
    """The plan with what the leaves under each node of ``depth`` leave over given to the one with the most room, or by room."""
    cut = _small(_edges(sized, _small(epochs(plan)), seed))
    kept = _prefix(_ordered(sized.drop("_in"), cut, seed, "_edge", "_before")).groupBy(*LEVELS).agg(F.max("_run").alias("_run"))
    whole = F.when(F.col("l._edge") == BUCKETS, F.col("l._rest")).otherwise(F.coalesce("r._run", "l._before"))
    got = cut.alias("l").join(kept.alias("r"), _same(LEVELS), "left").select("l.*", (F.col("l._full") * F.col("l.t") + whole).alias("_got"))
    got = got.withColumn("_room", F.col("t") * max_epochs - F.col("_got"))
    parent = LEVELS[:depth]
    path = F.struct(*LEVELS)
    spare = F.sum(F.col("_take") - F.col("_got")).alias("_spare")
    groups = got.groupBy(*parent).agg(spare, F.sum("_room").alias("_rooms"), F.max("_room").alias("_most"), F.max_by(path, F.struct("_room", path)).alias("_who"))
    shared = got.alias("l").join(_small(groups).alias("r"), _same(parent)).select("l.*", "r._spare", "r._rooms", "r._most", "r._who")
    # One leaf takes all if it can; otherwise each leaf takes by its room.
    one = F.when(path.eqNullSafe(F.col("_who")), F.col("_spare")).otherwise(0)
    each = F.floor(F.col("_room") * F.least(F.lit(1.0), F.col("_spare") / F.greatest("_rooms", F.lit(1))))
    more = F.when(F.col("_most") >= F.col("_spare"), one).otherwise(each)
    return written(shared.select(*LEVELS, "t", (F.col("_got") + more).cast("long").alias("_take")), "plan")


def mix(docs: DataFrame, levels: tuple[Column, Column, Column], target_share: float, weights: dict[tuple, float], max_epochs: int = 2, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """The rows of the mixture, ``docs`` with ``mix_epoch``, ``mix_tokens`` and the leaf as ``mix_domain``, ``mix_language``,
    ``mix_source``; a row appears once for each epoch it is in.

    ``target_share`` is the size asked for, as a share of all tokens.  Tokens are words unless a column is given.
    """
    count = tokens if tokens is not None else F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))
    added = ("mix_epoch", "mix_tokens", *["mix" + c for c in LEVELS])
    columns = [c for c in docs.columns if c not in added]
    # Maps and variants have no order and no hash; rows that differ in them alone are alike here.
    orderable = [c for c, t in docs.dtypes if c in columns and "map<" not in t and "variant" not in t]
    # The input row travels as one column, so that none of its names can clash with those used here.
    sized = docs.select(F.struct(*columns).alias("_in"), *[c.cast("string").alias(n) for c, n in zip(levels, LEVELS, strict=True)], count.cast("long").alias("mix_tokens"), F.xxhash64(*orderable).alias("_row"))
    sized = written(sized, "mix")
    leaves = written(sized.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("t")), "leaves")
    plan = written(planned(leaves, target_share, weights, max_epochs), "plan")
    for depth in range(len(LEVELS) - 1, -1, -1):
        plan = _topped_up(sized, plan, depth, max_epochs, seed)
    cut = _small(_edges(sized, _small(epochs(plan)), seed))

    placed = _ordered(sized, cut, seed, "_edge", "_before")
    whole = placed.filter("_full > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
    inside = placed.filter("_bucket < _edge and _rest > 0").withColumn("mix_epoch", F.col("_full"))
    part = _prefix(placed).withColumn("mix_epoch", F.col("_full")).drop("_run")
    return whole.unionByName(inside).unionByName(part).select("_in.*", "mix_epoch", "mix_tokens", *[F.col(c).alias("mix" + c) for c in LEVELS])


#: Target weights of the registered query: languages by weight, sources alike within a language.
WEIGHTS = {("a",): 2.0, ("b",): 1.0, ("a", "en"): 4.0, ("a", "de"): 2.0, ("b", "en"): 1.0, ("b", "fr"): 2.0}


def tree(docs: DataFrame) -> tuple[Column, Column, Column]:
    """Domain, language and source of a document: sources are dealt to two domains by their number's parity."""
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return F.when(number % 2 == 0, "a").otherwise("b"), F.col("lang"), F.col("source")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, tree(docs), 0.6, WEIGHTS)
    return mixed.select("doc_id", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"), F.col("mix_domain").alias("domain"), F.col("mix_language").alias("language"), F.col("mix_source").alias("source"))
