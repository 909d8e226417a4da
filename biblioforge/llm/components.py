"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every vertex draws an exponentially distributed head start; clusters grow along the
edges from the vertices that start first, so that a vertex joins the centre with the
least (distance - head start). Clusters are contracted to super-vertices, the edges
between clusters are the next level's graph, and the assignments of all levels are
composed at the end. An edge is cut with a probability of about ``beta``, so the number
of levels grows with the logarithm of the longest chain.

Growth is stopped after ``hops`` rounds. That cannot join what is not linked (a
centre's name only ever travels along edges), it just leaves more edges to the next level.

Defined results: NULL ends, self-links and repeated or reversed pairs add nothing; a
vertex without a link to another one does not come out; an empty input gives an empty
result; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioforge.operators.skew import join_unique
from biblioforge.session import cut

#: Rate of the head starts, rounds of growth in a level, and a level no input can reach by chance.
BETA, HOPS, MAX_LEVELS = 0.2, 4, 400


def _uniform(vertex: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the vertex and the seed alone, so that retried tasks repeat it.

    A string as the seed leaves the generated code of all levels the same.
    """
    return (F.pmod(F.xxhash64(vertex, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _graph(pairs: DataFrame) -> DataFrame:
    """(u, v, step): each link of (a, b) both ways with step 1, and each end to itself with step 0."""
    ends = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    step = lambda u, v, n: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(n).alias("step"))
    loops = [step("a", "a", 0.0), step("b", "b", 0.0)]
    return ends.select(F.inline(F.array(step("a", "b", 1.0), step("b", "a", 1.0), *loops))).distinct()


def _grow(graph: DataFrame, rows: int, seed: str, beta: float, hops: int) -> DataFrame:
    """(v, centre) after ``hops`` rounds."""
    start = F.log(_uniform(F.col("u"), seed)) / beta  # minus the head start
    state = graph.where("step = 0").select("u", start.alias("cost"), F.col("u").alias("centre"))
    for _ in range(hops):
        offers = join_unique(graph, state, ["u"], most_rows=rows)
        offers = offers.select("v", (F.col("cost") + F.col("step")).alias("cost"), "centre")
        state = offers.groupBy(F.col("v").alias("u")).agg(F.min("cost").alias("cost"), F.min_by("centre", "cost").alias("centre"))
    return state.select(F.col("u").alias("v"), "centre")


def connected_components(pairs: DataFrame, a: str, b: str, *, beta: float = BETA, hops: int = HOPS, seed: int = 11) -> DataFrame:
    """(vertex, root) for each vertex linked to another; ``root`` is the smallest vertex of its component.

    A component of any size costs no task more than its share: joins go through
    ``join_unique``, and minima are combined before they are shuffled.
    """
    graph = cut(_graph(pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    levels: list[tuple[DataFrame, int]] = []
    while rows := graph.count():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the decomposition does not end")
        assigned = cut(_grow(graph, rows, f"{seed}.{len(levels)}", beta, hops))
        levels.append((assigned, rows))
        links = graph.where("step = 1 and u < v").select("u", "v")
        left = assigned.select(F.col("v").alias("u"), F.col("centre").alias("a"))
        right = assigned.select("v", F.col("centre").alias("b"))
        between = join_unique(join_unique(links, left, ["u"], most_rows=rows), right, ["v"], most_rows=rows)
        graph = cut(_graph(between))
    if not levels:
        return graph.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    composed = levels[-1][0]
    for lower, rows in reversed(levels[:-1]):
        upper = composed.select(F.col("v").alias("centre"), F.col("centre").alias("top"))
        composed = join_unique(lower, upper, ["centre"], "left", most_rows=rows).select("v", F.coalesce("top", "centre").alias("centre"))
    composed = cut(composed)
    names = composed.groupBy("centre").agg(F.min("v").alias("root"))
    return join_unique(composed, names, ["centre"], most_rows=levels[0][1]).select(F.col("v").alias("vertex"), "root")
