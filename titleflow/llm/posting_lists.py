"""Nearest neighbours over balanced posting lists.

A sample is halved again and again along the line between two centres, so all parts stay equally large; the means of the
parts, moved a few times to the means of their nearest vectors, are the centroids of the lists. A graph of neighbouring
centroids is searched in memory, best first. A vector is put on its nearest list, and near a boundary on those of the
next centroids too. A query reads the lists whose centroids are not much farther than the nearest one, and distances to
their vectors are exact.

Centroids and graph are of bounded size and are sent to every executor; vectors meet queries by a join on spans of neighbouring
lists. Equal vectors are indexed once, with the few smallest ids that a result can name, and equal queries are asked once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleflow.llm.common import per_batch, small_batches, written

#: Vectors that centroids are fitted on and their bytes, at most; vectors that a list is meant for; lists at most, and the
#: sampled vectors that a list has at least.
SAMPLE, SAMPLE_BYTES, LIST, LISTS, SAMPLED = 100_000, 1 << 26, 32, 8_192, 12
#: Neighbours of a centroid that the graph looks for, and those that it keeps.
DEGREE, WIDTH = 16, 28
#: Lists of a vector at most, how much farther than the nearest centroid theirs may be, and the beam that finds them.
REPLICAS, REPLICA_RATIO, REPLICA_BEAM = 4, 1.2, 16
#: How much farther than the nearest centroid those of the lists that a query reads may be; the lists that it reads at most, as
#: parts of the root of all lists and of all lists, and at least, as where it is a centroid itself.
PROBE_RATIO, MOST_BY_ROOT, MOST_BY_ALL, LEAST_BY_ROOT = 1.35, 4.5, 0.4, 1.0
#: Rounds that move the centroids; centroids that a search opens at once, and vectors that it searches for at once.
ROUNDS, OPENED, SEARCHED = 4, 8, 256
#: Neighbouring lists whose vectors and queries meet, and the vectors and the queries of one group; more are dealt into several.
SPAN, PART, ASKED = 16, 4_096, 4_096


@dataclass
class Centroids:
    points: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found for each vector, nearest first, and their distances; -1 and inf where
        there are fewer than the beam."""
        parts = [self._search(vectors[a:a + SEARCHED].astype(np.float32), min(beam, len(self.points))) for a in range(0, len(vectors), SEARCHED)]
        width = max(ids.shape[1] for ids, _ in parts)
        fill = ((-1, 0), (np.inf, 1))
        return tuple(np.concatenate([np.pad(part[k], ((0, 0), (0, width - part[k].shape[1])), constant_values=value) for part in parts]) for value, k in fill)

    def _search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, count = len(vectors), len(self.points)
        seen = np.zeros((n, count + 1), dtype=bool)
        seen[:, count] = True
        row = np.arange(n)[:, None]

        def measured(ids: np.ndarray) -> np.ndarray:
            gap = self.points[np.minimum(ids, count - 1)] - vectors[:, None, :]
            return np.where(ids < count, np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)), np.inf)

        ids = np.tile(self.entries, (n, 1))
        seen[row, ids] = True
        far, open_ = measured(ids), np.ones(ids.shape, dtype=bool)
        while True:
            order = np.lexsort((ids, far), axis=1)[:, :beam]
            ids, far, open_ = (np.take_along_axis(x, order, axis=1) for x in (ids, far, open_))
            live = open_ & np.isfinite(far)
            if not live.any():
                break
            # the nearest ones that are not opened yet, some at once
            first = np.argsort(~live, axis=1, kind="stable")[:, :OPENED]
            taken = np.take_along_axis(live, first, axis=1)
            np.put_along_axis(open_, first, False, axis=1)
            new = np.where(taken[:, :, None], self.neighbours[np.minimum(np.take_along_axis(ids, first, axis=1), count - 1)], count).reshape(n, -1)
            new = np.where(seen[row, new], count, new)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = count
            new.sort(axis=1)
            new = new[:, :max(1, int((new < count).sum(axis=1).max()))]
            seen[row, new] = True
            ids, far = np.concatenate([ids, new], axis=1), np.concatenate([far, measured(new)], axis=1)
            open_ = np.concatenate([open_, new < count], axis=1)
        return np.where(np.isfinite(far), ids, -1), far

    def lists_of(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The lists that hold each vector."""
        ids, far = self.search(vectors, REPLICA_BEAM)
        near = (far <= REPLICA_RATIO * far[:, :1]) & (np.arange(ids.shape[1]) < REPLICAS) & (ids >= 0)
        near[:, 0] = True
        return [own[keep].astype(np.int32) for own, keep in zip(ids, near)]

    def probed(self) -> tuple[int, int]:
        """The lists that a query reads, at least and at most."""
        count = len(self.points)
        most = max(1, int(min(MOST_BY_ROOT * count**0.5, MOST_BY_ALL * count + 1)))
        return min(most, max(1, int(LEAST_BY_ROOT * count**0.5))), most

    def probes(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The lists that each query reads: those whose centroids are not much farther than the nearest one."""
        least, most = self.probed()
        ids, far = self.search(vectors, int(1.2 * most) + 1)
        place = np.arange(ids.shape[1])
        near = ((far <= PROBE_RATIO * far[:, :1]) | (place < least)) & (place < most) & (ids >= 0)
        return [own[keep].astype(np.int32) for own, keep in zip(ids, near)]


def balanced_parts(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    """Row numbers of ``parts`` parts that differ in size by one or little more."""
    random = np.random.default_rng(7)
    out, todo = [], [(np.arange(len(vectors)), parts)]
    while todo:
        rows, count = todo.pop()
        if count <= 1 or len(rows) < 2:
            out.append(rows)
            continue
        own = vectors[rows]
        centres = own[random.choice(len(rows), 2, replace=False)]
        for _ in range(8):
            gap = ((own - centres[0]) ** 2).sum(axis=1) - ((own - centres[1]) ** 2).sum(axis=1)
            order = np.argsort(gap, kind="stable")
            cut = len(rows) * (count // 2) // count
            centres = np.stack([own[order[:cut]].mean(axis=0) if cut else centres[0], own[order[cut:]].mean(axis=0)])
        todo += [(rows[order[:cut]], count // 2), (rows[order[cut:]], count - count // 2)]
    return [rows for rows in out if len(rows)]


def fit(sample: np.ndarray, lists: int) -> Centroids:
    """Centroids and their graph; each is linked with its nearest ones and a few by chance, both ways."""
    points = np.stack([sample[rows].mean(axis=0) for rows in balanced_parts(sample, max(1, min(lists, len(sample))))]).astype(sample.dtype)
    for _ in range(ROUNDS if len(points) > 1 else 0):
        sums, sizes = np.zeros_like(points), np.zeros(len(points))
        square = (points**2).sum(axis=1)
        for a in range(0, len(sample), 1024):
            own = sample[a:a + 1024]
            nearest = (square - 2 * own @ points.T).argmin(axis=1)
            order = np.argsort(nearest, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(nearest[order]) > 0])
            sums[nearest[order][starts]] += np.add.reduceat(own[order], starts)
            sizes += np.bincount(nearest, minlength=len(points))
        points = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points)
    count = len(points)
    random = np.random.default_rng(11)
    square = (points**2).sum(axis=1)
    links: list[set[int]] = [set() for _ in range(count)]
    for a in range(0, count, 1024):
        gaps = square[a:a + 1024, None] + square[None, :] - 2 * points[a:a + 1024] @ points.T
        gaps[np.arange(len(gaps)), np.arange(a, a + len(gaps))] = np.inf
        near = np.argpartition(gaps, min(DEGREE, count - 1) - 1, axis=1)[:, :DEGREE] if count > 1 else np.empty((1, 0), int)
        for k, own in enumerate(near, start=a):
            for c in [*own.tolist(), *random.integers(0, count, 2).tolist()]:
                if c != k:
                    links[k].add(c)
                    links[c].add(k)
    width = min(WIDTH, max(map(len, links), default=0)) or 1
    table = np.full((count, width), count, dtype=np.int64)
    for k, own in enumerate(links):
        ranked = sorted(own, key=lambda c: float(((points[c] - points[k]) ** 2).sum()))
        # the farthest few stay, as they lead across the graph
        kept = ranked if len(ranked) <= width else ranked[:width - 2] + ranked[-2:]
        table[k, :len(kept)] = kept
    entries = np.unique(np.linspace(0, count - 1, min(count, 32)).astype(np.int64))
    return Centroids(points.astype(np.float32), table, entries)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def search(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` holds for (a condition on ``vec_id``), its ``k`` nearest
    rows found, itself excepted; all others, if there are fewer than ``k``.

    ``score``: Euclidean distance in double precision; ties go to the smaller id. Rows with a null id, and vectors that are null,
    zero, hold null or non-finite components or are not as long as the most vectors are, take no part. Of rows
    repeating an id with other vectors each is a candidate, and the id's nearest counts; the query is the one
    with the smallest vector. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = "array<float>" if dict(df.select(F.col(f"`{vector_col}`").alias("v")).dtypes)["v"] == "array<float>" else "array<double>"
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (lengths.n if lengths else 0))
    # of equal vectors, only so many ids can be among the nearest
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.distinct().withColumn("n", first).where(F.col("n") <= k + 1)
    vectors = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = written(vectors.withColumn("v", F.monotonically_increasing_id()), "lists-vectors")
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = written(asked.join(vectors.select("vector", "v"), "vector").select(F.col("vec_id").alias("query_id"), "v"), "lists-queries")
    total, ids = vectors.agg(F.count("*"), F.sum(F.size("ids"))).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (4 * lengths.n)))
    drawn = vectors.orderBy(F.xxhash64("vector"), "vector").limit(most) if total > most else vectors.orderBy("vector")
    sample = _matrix(drawn.select(F.col("vector").cast("array<float>").alias("vector")).toArrow()["vector"].combine_chunks(), np.float32)
    lists = min(LISTS, -(-total // LIST), -(-len(sample) // SAMPLED) if total > most else total)
    shared = spark.sparkContext.broadcast(fit(sample, lists))

    def listed(rows: DataFrame, choose: str) -> DataFrame:
        """The rows with the lists that ``choose`` finds for their vectors, one row per span of lists."""
        carried = [c for c in rows.columns if c != "vector"]

        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = getattr(shared.value, choose)(_matrix(batch["vector"]))
                take = pa.array(np.repeat(np.arange(batch.num_rows), [len(own) for own in found]))
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), batch["vector"].take(take), *(batch[c].take(take) for c in carried)], ["list", "vector", *carried])

            return step

        types = dict(rows.dtypes)
        return rows.select("vector", *carried).mapInArrow(
            per_batch(make), ", ".join([f"list int, vector {kind}", *(f"{c} {types[c]}" for c in carried)]))

    index = written(listed(vectors, "lists_of").withColumn("span", F.floor(F.col("list") / SPAN).cast("int")), "lists-index")
    parts = index.groupBy("span").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    wanted = vectors.join(asked.select("v").distinct(), "v", "left_semi").select("v", "vector")

    def nearest(reads: DataFrame) -> DataFrame:
        """``v, vec_id, score`` from queries ``v, vector, list``: the nearest ids in the lists read, one more than asked."""
        held = reads.withColumn("span", F.floor(F.col("list") / SPAN).cast("int")).groupBy("span", "v").agg(
            F.first("vector").alias("vector"), F.collect_list("list").alias("lists"))
        held = written(held, "lists-reads")
        blocks = held.groupBy("span").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("blocks")).join(parts, "span")
        here = index.join(blocks, "span").select(
            "span", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            "list", "v", "vector", "ids")
        read = held.join(blocks, "span").select(
            "span", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"),
            "v", "vector", "lists")

        def compare(key: tuple, here: pd.DataFrame, read: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[int, list[int], float]] = []
            if len(here) and len(read):
                points, own_list, own_ids = np.stack(here["vector"].to_numpy()).astype(np.float64), here["list"].to_numpy(), here["ids"].to_list()
                own_vector = here["v"].to_numpy()
                least = np.array([own[0] for own in own_ids])
                for query, vector, chosen in zip(read["v"], read["vector"], read["lists"]):
                    at = np.flatnonzero(np.isin(own_list, chosen))
                    gap = points[at] - np.asarray(vector, dtype=np.float64)
                    far = np.sqrt((gap * gap).sum(axis=1))
                    # a vector may be on several of the lists
                    _, once = np.unique(own_vector[at], return_index=True)
                    for one in once[np.lexsort((least[at[once]], far[once]))[:k + 1]]:
                        out.append((query, own_ids[at[one]], far[one]))
            return pd.DataFrame(out, columns=["v", "ids", "score"])

        groups = ["span", "part", "block"]
        met = here.groupBy(*groups).cogroup(read.groupBy(*groups)).applyInPandas(compare, "v bigint, ids array<bigint>, score double")
        each = met.select("v", F.explode("ids").alias("vec_id"), "score").groupBy("v", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("v").orderBy("score", "vec_id"))
        return written(each.withColumn("n", rank).where(F.col("n") <= k + 1).drop("n"), "lists-nearest")

    found = nearest(listed(wanted, "probes"))
    # queries whose lists hold too few vectors read all lists
    short = wanted.join(found.groupBy("v").count().where(F.col("count") >= min(k + 1, ids)).select("v"), "v", "left_anti")
    if not short.isEmpty():
        every = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(shared.value.points) - 1)))).withColumn("list", F.col("list").cast("int"))
        found = found.join(short.select("v"), "v", "left_anti").unionByName(nearest(every))
    others = asked.join(found, "v").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
