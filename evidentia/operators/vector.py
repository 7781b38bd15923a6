"""Vector operators: exact cosine neighbours in blocks, the neighbour graph and what is derived from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that a block holds at most; a pair of blocks is one matrix product in one task.
BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _nearest(k: int, floor: float):
    """The k best points of a block for each of its queries, those that tie with the last included, itself left out."""

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "id": [], "similarity": []}).astype({"q": "int64", "id": "int64", "similarity": "float64"})
        right = right.sort_values("p")
        sims = np.stack(left["v"].to_numpy()).astype(np.float64) @ np.stack(right["v"].to_numpy()).astype(np.float64).T
        ids = right["p"].to_numpy()
        sims[left["q"].to_numpy()[:, None] == ids[None, :]] = -2
        most = min(k, len(ids))
        kth = np.partition(sims, len(ids) - most, axis=1)[:, len(ids) - most]
        at = np.nonzero(sims >= np.maximum(kth - 1e-9, floor)[:, None])
        return pd.DataFrame({"q": left["q"].to_numpy()[at[0]], "id": ids[at[1]], "similarity": sims[at]})

    return block


def _ranked(found: DataFrame, k: int) -> DataFrame:
    found = found.withColumn("similarity", F.round("similarity", 6))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, points: DataFrame, k: int, floor: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(q, id, similarity, rank): the k most similar points of each query, itself left out, by similarity, then id.

    Exact: both sides are dealt into blocks by id, each pair of blocks is one matrix product, and only the k best of each query and block leave it. A vector is
    sent once per block of the other side: for many queries against many points see Index.
    """
    n, m = queries.count(), points.count()
    rows, cols = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    q = queries.select(F.col(id_col).alias("q"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(rows)).cast("int").alias("i"))
    p = points.select(F.col(id_col).alias("p"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(cols)).cast("int").alias("j"))
    q = q.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).groupBy("i", "j")
    p = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).groupBy("i", "j")
    found = q.cogroup(p).applyInPandas(_nearest(k, floor), "q long, id long, similarity double").filter(F.col("similarity") >= max(floor, -1.5))
    return _ranked(found, k)


class Index:
    """Cells of unit vectors around centroids, for searches that look at a query's nearest cells only.

    Centroids are fitted on at most `sample` vectors, the first in the order of a hash; every point is in the index. A point is sent once, a query once per
    cell and block of it that it looks at. What a search finds is exact within those cells; recall() measures what it misses.
    """

    def __init__(self, points: DataFrame, cells: int, sample: int = 20_000, rounds: int = 15, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.points = points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        own = self.points.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
        x = np.stack(own["v"].to_numpy()).astype(np.float64) if len(own) else np.zeros((1, 1))
        # far ones first, so that no group of vectors is without a centroid
        chosen, far = [0], x @ x[0]
        for _ in range(min(cells, len(x)) - 1):
            chosen.append(int(far.argmin()))
            far = np.maximum(far, x @ x[chosen[-1]])
        c = x[chosen]
        for _ in range(rounds):
            of = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, of, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
        self.centroids = c
        self.sizes = None

    def _cells(self, rows: DataFrame, probes: int) -> DataFrame:
        """rows (id, v) with their nearest cells, one row each."""
        centroids = self.centroids

        def near(vectors: pd.Series) -> pd.Series:
            sims = np.stack(vectors.to_numpy()).astype(np.float64) @ centroids.T if len(vectors) else np.zeros((0, 1))
            return pd.Series(list(np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        return rows.withColumn("cell", F.explode(F.pandas_udf(near, "array<int>")("v")))

    def search(self, queries: DataFrame, k: int, probes: int = 4, floor: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """top_k() of queries among the points of their `probes` nearest cells. Large cells are searched block by block."""
        from .graph import held

        if self.sizes is None:
            self.points = held(self._cells(self.points, 1))
            self.sizes = held(self.points.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        p = self.points.join(self.sizes, "cell").select(F.col("id").alias("p"), "v", "cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
        asked = self._cells(queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), probes).join(self.sizes, "cell")
        q = asked.select(F.col("id").alias("q"), "v", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        found = q.groupBy("cell", "block").cogroup(p.groupBy("cell", "block")).applyInPandas(_nearest(k, floor), "q long, id long, similarity double")
        return _ranked(found.filter(F.col("similarity") >= max(floor, -1.5)), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of exact neighbours (q, id) that were found."""
    n = exact.count()
    return exact.join(found.select("q", "id"), ["q", "id"], "left_semi").count() / n if n else 1.0


def neighbor_graph(points: DataFrame, k: int = 12, floor: float = 0.72, id_col: str = "vec_id", vector_col: str = "embedding", index: Index | None = None, probes: int = 4) -> DataFrame:
    """(a, b, similarity) with a < b: unordered pairs of which one is among the other's k nearest, the larger similarity. With an index, neighbours are those
    that its search finds."""
    near = top_k(points, points, k, floor, id_col, vector_col) if index is None else index.search(points, k, probes, floor, id_col, vector_col)
    return near.groupBy(F.least("q", "id").alias("a"), F.greatest("q", "id").alias("b")).agg(F.max("similarity").alias("similarity"))


def relation(edges: DataFrame, same: Column, opposite: Column, equivalent: float, refines: float) -> DataFrame:
    """edges with relation: contradicts, equivalent, refines, same_topic or related, by the first that fits."""
    return edges.withColumn(
        "relation",
        F.when(same & opposite, "CONTRADICTS").when(same & (F.col("similarity") >= equivalent), "EQUIVALENT").when(same & (F.col("similarity") >= refines), "REFINES").when(same, "SAME_TOPIC").otherwise("RELATED"),
    )


def vector_admission(near: DataFrame) -> DataFrame:
    """(q, decision, by) from neighbours (q, id, similarity, same_statement, same_topic, opposite): challenges, reinforces, refines or novel, by the best
    neighbour of .90 or more that decides anything."""
    decided = F.when(F.col("same_statement") & F.col("opposite"), "challenges").when(F.col("same_statement") & (F.col("similarity") >= 0.94), "reinforces").when(F.col("same_topic"), "refines")
    best = near.withColumn("d", F.when(F.col("similarity") >= 0.90, decided)).groupBy("q").agg(F.min(F.when(F.col("d").isNotNull(), F.struct((-F.col("similarity")).alias("s"), "id", "d"))).alias("b"))
    return best.select("q", F.coalesce("b.d", F.lit("novel")).alias("decision"), F.col("b.id").alias("by"))


def boundary_scores(features: dict[str, Column], weights: dict[str, dict[str, float]], confidence: float, margin: float) -> Column:
    """Struct (label, score): the best of linear scores, UNRESOLVED below the confidence or the lead; of equal ones the first declared."""
    value = lambda name: 1 - features[name[2:]] if name.startswith("1-") else features[name]
    scored = []
    for k, (label, own) in enumerate(weights.items()):
        total = F.lit(0.0)
        for name, w in own.items():
            total = total + w * value(name)
        scored.append(F.struct((-F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)).alias("s"), F.lit(k).alias("k"), F.lit(label).alias("label")))
    ordered = F.array_sort(F.array(*scored))
    first, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    low = (-first["s"] < confidence) | (F.round(second["s"] - first["s"], 6) < margin)
    return F.struct(F.when(low, "UNRESOLVED").otherwise(first["label"]).alias("label"), (-first["s"]).alias("score"))
