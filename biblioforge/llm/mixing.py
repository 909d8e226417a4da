"""Mixing sources to target weights by capped water-filling.

Each source is given its target share of the mix; a source that would need more than its
largest number of repetitions is held there, and what it lacks is spread over the others
in proportion to their targets, until nothing more has to be held. The repetitions of a
source are a whole number plus a seeded fraction of its documents.

Defined results: sources without a target, documents without a source and documents
without tokens are not used; a source without documents holds nothing; if even all
repetitions do not fill the mix it is smaller; ties in the seeded order go by document
id; a target source listed twice counts once, by its largest values; empty tables give an
empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from biblioforge.session import cut

#: The seeded order of a source is cut into so many equal parts to find where its fraction ends.
PARTS = 4096


def water_fill(available: dict[str, int], share: dict[str, float], most: dict[str, int], size: float) -> dict[str, float]:
    """Tokens of each source in the mix."""
    filled: dict[str, float] = {}
    free = {s for s in share if share[s] > 0 and available.get(s, 0) > 0 and most[s] > 0}
    while free:
        left, weight = size - sum(filled.values()), sum(share[s] for s in free)
        held = {s for s in free if left * share[s] / weight >= available[s] * most[s]}
        if not held:
            return filled | {s: left * share[s] / weight for s in free}
        filled |= {s: float(available[s] * most[s]) for s in held}
        free -= held
    return filled


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_copies, n_tokens, target_share, actual_share) of each document used.

    ``docs`` has doc_id, source and n_tokens; ``targets`` has source, target_share and max_repeats
    and one row for each source, of which there are few.
    """
    spark = docs.sparkSession
    docs = cut(docs.select("doc_id", "source", "n_tokens"))
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(
        F.broadcast(targets.select("source").distinct()), "source").collect()}
    size = docs.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("most")).collect()
    filled = water_fill(sizes, {r["source"]: r["share"] for r in wanted}, {r["source"]: r["most"] for r in wanted}, size)
    plan = []
    for r in wanted:
        tokens = filled.get(r["source"], 0.0)
        have = sizes.get(r["source"], 0)
        whole = min(r["most"], math.floor(tokens / have + 1e-12)) if have else 0
        plan.append((r["source"], float(r["share"]), whole, max(0.0, tokens - whole * have) if whole < r["most"] else 0.0))
    plan_df = spark.createDataFrame(plan, "source string, target_share double, whole int, rest double")
    drawn = docs.where("n_tokens > 0").join(F.broadcast(plan_df), "source")
    drawn = drawn.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)))
    drawn = drawn.withColumn("part", F.floor(F.col("draw") * F.lit(PARTS) / F.lit(1 << 40)).cast("int"))
    # The parts before each part: at most PARTS rows a source.
    before = drawn.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("source", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), "n")
    drawn = drawn.join(F.broadcast(before), ["source", "part"])
    inside = drawn.where("before + n <= rest").withColumn("extra", F.lit(1))
    outside = drawn.where("before >= rest").withColumn("extra", F.lit(0))
    edge = drawn.where("before < rest and before + n > rest")  # one part a source
    running = Window.partitionBy("source").orderBy("draw", "doc_id")
    edge = edge.withColumn("upto", F.col("before") + F.sum("n_tokens").over(running))
    edge = edge.withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).drop("upto")
    used = inside.unionByName(outside).unionByName(edge)
    used = used.select("doc_id", "source", (F.col("whole") + F.col("extra")).cast("int").alias("n_copies"), "n_tokens", "target_share")
    used = cut(used.where("n_copies > 0"))
    shares = used.groupBy("source").agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("held"))
    total = shares.agg(F.sum("held")).first()[0] or 0
    shares = shares.select("source", (F.col("held") / F.lit(float(total or 1))).alias("actual_share"))
    return used.join(F.broadcast(shares), "source").select("doc_id", "source", "n_copies", "n_tokens", "target_share", "actual_share")
