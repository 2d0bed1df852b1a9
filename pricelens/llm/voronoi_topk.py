"""Exact top-k search by inner product, as a Voronoi join.

Pivots, data rows chosen by hash, cut data and queries into cells: a row is in
the cell of the nearest pivot. A data cell's summary is its number of rows,
largest norm and farthest distance from the pivot; a query cell's is its number
of queries, largest norm, radius and bound: the least, over its queries, of the
k-th best score among some rows of their own cell. By the triangle inequality
the summaries bound every score between two cells, and between a query cell and
a row. Neighbouring query cells make groups, and a row is sent to a group only
if a bound reaches that of one of its cells; there it meets all the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, saved, table

#: Pivots come to the driver, as do as many summaries at most.
PIVOTS = 256
#: Queries in a group, rows of a cell that bounds are taken from, bytes of vectors in a chunk that a group's queries meet at once.
QUERIES_A_GROUP, HOME_ROWS, CHUNK_BYTES = 512, 1000, 16_000_000
#: Components below this multiply as doubles without loss (8192 of them); others take longer integers.
SMALL, EXACT, LEAST = 2**20, 2**53, -(2**63)
VECTOR = "vec_id long, v binary"


def matrix(vectors: list[bytes], dims: int = 0) -> np.ndarray:
    """Rows of whole numbers as doubles; shorter vectors end in zeros, which add nothing to a product."""
    n = max([len(v) // 8 for v in vectors] + [dims])
    return np.frombuffer(b"".join(bytes(v).ljust(8 * n, b"\0") for v in vectors), "<f8").reshape(len(vectors), n)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly, over the components that both have: as 64-bit integers where these hold all, else as Python's."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if n == 0 or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * n
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < -LEAST and max(np.abs(a).max(), np.abs(b).max()) < -LEAST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return whole(a) @ whole(b).T


def best(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query its k highest (score, id), ties to smaller ids, its own row left out."""
    found: list[list[tuple[int, int]]] = [[] for _ in own]
    split = lambda x: [p for p in (np.flatnonzero(np.abs(x).max(1, initial=0) < SMALL), np.flatnonzero(np.abs(x).max(1, initial=0) >= SMALL)) if len(p)]
    for qs in split(queries):
        for rs in split(rows):
            scores = products(queries[qs], rows[rs])
            for q, s in zip(qs, scores):
                other = ids[rs] != own[q]
                s, i = s[other], ids[rs][other]
                if s.dtype != object and len(s) > k:
                    keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    s, i = s[keep], i[keep]
                found[q] += sorted(zip(s.tolist(), i.tolist()), key=lambda x: (-x[0], x[1]))[:k]
    return [sorted(f, key=lambda x: (-x[0], x[1]))[:k] for f in found]


def integers(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id and v, the bytes of floor(scale * x) as doubles; without null ids, null vectors and null or non-finite components."""
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(good)
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, at = np.floor(v.values.to_numpy(zero_copy_only=False) * scale).astype("<f8"), v.offsets.to_numpy()
            if not np.isfinite(flat).all():
                raise OverflowError("a scaled component is beyond a double")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([flat[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())], names=["vec_id", "v"])

    return df.mapInArrow(run, VECTOR)


class Space:
    """Pivots and the bounds that they give, as bounded arrays that travel with a task."""

    def __init__(self, pivots: list):
        self.ids = np.array([r.vec_id for r in pivots])
        self.at = matrix([r.v for r in pivots])
        self.norm = norms(self.at)

    def padded(self, dims: int) -> np.ndarray:
        return np.pad(self.at, ((0, 0), (0, max(0, dims - self.at.shape[1]))))

    def distances(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of rows from pivots, and products."""
        dot = x @ self.padded(x.shape[1])[:, : x.shape[1]].T
        return np.sqrt(np.maximum(size[:, None] ** 2 + self.norm[None, :] ** 2 - 2 * dot, 0)), dot

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cell, distance from its pivot, norm of each row."""
        x = x if x.shape[1] >= self.at.shape[1] else np.pad(x, ((0, 0), (0, self.at.shape[1] - x.shape[1])))
        size = norms(x)
        d, _ = self.distances(x, size)
        cell = d.argmin(1)
        return cell, d[np.arange(len(x)), cell], size

    def summarise(self, data: list, asked: list) -> None:
        """Keeps what cells hold: lists of rows (cell, n, size, far) and (cell, n, size, far, bound), a row each cell at most."""
        self.cells = np.array([r.cell for r in asked])
        self.size, self.bound = np.array([r.size for r in asked]), np.array([r.bound for r in asked])
        # distances by way of products are off by some 1e-7 of the norms
        self.radius = np.array([r.far for r in asked]) + 1e-6 * (1 + self.norm[self.cells] + self.size)
        # which query cells the rows of a data cell can matter to
        self.open = np.zeros((len(self.at), len(asked)), bool)
        for r in data:
            far = r.far + 1e-6 * (1 + self.norm[r.cell] + r.size)
            d, dot = self.distances(self.at[r.cell : r.cell + 1], self.norm[r.cell : r.cell + 1])
            apart = d[0, self.cells] - self.radius - far
            first = dot[0, self.cells] + self.radius * self.norm[r.cell] + far * (self.norm[self.cells] + self.radius)
            self.open[r.cell] = self.reaches(first, apart, self.norm[r.cell] + far)

    def reaches(self, first: np.ndarray, apart: np.ndarray, size) -> np.ndarray:
        """Whether a score can reach the query cells' bounds: at most first, and at most what distances of apart or more leave."""
        second = (self.size**2 + size**2 - np.maximum(apart, 0) ** 2) / 2
        most = np.minimum(first, second) + 1 + 1e-9 * ((self.size + 1) * size + self.size**2 + size**2)
        return ~(most < self.bound)  # so that what isn't a number is kept

    def needs(self, x: np.ndarray) -> np.ndarray:
        """Which query cells each row may be among the results of."""
        cell, _, size = self.place(x)
        d, dot = self.distances(x, size)
        d, dot, size = d[:, self.cells], dot[:, self.cells], size[:, None]
        apart = d - self.radius - 1e-6 * (1 + self.norm[self.cells] + size)
        return self.open[cell] & self.reaches(dot + self.radius * size, apart, size)


def grouped(space: Space, counts: dict[int, int]) -> tuple[dict[int, int], dict[int, int], int]:
    """(first group, number of groups) of each query cell: cells of many queries are split, cells of few join their neighbours; and how many there are."""
    first, parts, at = {}, {}, 0
    left = []
    for c in sorted(counts):
        if counts[c] > QUERIES_A_GROUP:
            first[c], parts[c] = at, -(-counts[c] // QUERIES_A_GROUP)
            at += parts[c]
        else:
            left.append(c)
    while left:
        head = left[0]
        d = ((space.at[left] - space.at[head]) ** 2).sum(1)
        room, took = QUERIES_A_GROUP, []
        for i in np.argsort(d, kind="stable"):
            if counts[left[i]] <= room:
                room -= counts[left[i]]
                took.append(left[i])
        first |= dict.fromkeys(took, at)
        parts |= dict.fromkeys(took, 1)
        left = [c for c in left if c not in took]
        at += 1
    return first, parts, at


def voronoi_parts(data: DataFrame, is_query, k: int, id_col: str, vec_col: str, scale: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows sent, queries asked), each by group and chunk; None where there are no rows or no queries."""
    spark = data.sparkSession
    vectors = integers(data, id_col, vec_col, scale)
    pivots = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOTS).collect()
    if not pivots:
        return None
    space = Space(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                cell, far, size = space.place(matrix(b.column("v").to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far), pa.array(size)], names=["vec_id", "v", "cell", "far", "size"])

    placed = vectors.mapInArrow(place, f"{VECTOR}, cell long, far double, size double")
    summary = [F.count("*").alias("n"), F.max("size").alias("size"), F.max("far").alias("far")]
    cells = placed.groupBy("cell").agg(*summary, F.max(F.octet_length("v")).alias("bytes")).collect()
    queries = saved(placed.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("v", "cell", "far", "size")).alias("x")).select("vec_id", "x.*"), "queries")
    counts = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None

    # bounds from some rows of a query's own cell, and from the pivots
    listed = lambda f, kind: F.get(F.array(*(F.lit(f(c)).cast(kind) for c in range(len(pivots)))), F.col("cell").cast("int"))
    rows = {r.cell: r.n for r in cells}
    parts = listed(lambda c: -(-counts.get(c, 0) // QUERIES_A_GROUP), "long")
    even = F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 11) / float(1 << 53)
    some = placed.filter((parts > 0) & (even < listed(lambda c: HOME_ROWS / max(rows.get(c, 0), 1), "double"))).select("cell", "vec_id", "v").distinct()
    some = some.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    near = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts))

    def bound(mine: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        q, own, least = matrix(mine["v"].tolist()), mine["vec_id"].to_numpy(), []
        pairs = [(space.ids, space.at), (home["vec_id"].to_numpy(), matrix(home["v"].tolist()))] if len(home) else [(space.ids, space.at)]
        for ids, x in pairs:
            least.append([float(f[-1][0]) if len(f) == k else -np.inf for f in best(ids, x, q, own, k)])
        least = np.array(least).max(0)
        return mine.drop(columns="part").assign(bound=least - 1 - 1e-12 * np.where(np.isfinite(least), np.abs(least), 0))

    bounded = near.groupBy("cell", "part").cogroup(some.groupBy("cell", "part")).applyInPandas(lambda a, b: bound(a, b) if len(a) else a.drop(columns="part").assign(bound=pd.Series(dtype=float)), f"{VECTOR}, cell long, far double, size double, bound double")
    bounded = saved(bounded, "bounded")
    space.summarise(cells, bounded.groupBy("cell").agg(*summary, F.min("bound").alias("bound")).collect())
    first, split, n_groups = grouped(space, counts)
    member = np.zeros((len(space.cells), n_groups), bool)
    for i, c in enumerate(space.cells):
        member[i, first[c] : first[c] + split[c]] = True
    n_chunks = -(-sum(r.n * r.bytes for r in cells) // CHUNK_BYTES) or 1
    told = spark.sparkContext.broadcast((space, member))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to the groups that may need it; to chunks in turn, so repeated rows are spread."""
        space, member = told.value
        turn = TaskContext.get().partitionId()
        for b in batches:
            if not len(b):
                continue
            need, chunk = space.needs(matrix(b.column("v").to_pylist())), (turn + np.arange(len(b))) % n_chunks
            turn += len(b)
            for g in range(member.shape[1]):
                i = np.flatnonzero(need[:, member[:, g]].any(1))
                if len(i):
                    part = b.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), g)), pa.array(chunk[i]), part.column("vec_id"), part.column("v")], names=["group", "chunk", "vec_id", "v"])

    sent = vectors.mapInArrow(send, f"group long, chunk long, {VECTOR}")
    group = listed(lambda c: first.get(c, 0), "long") + F.pmod(F.xxhash64("vec_id"), listed(lambda c: split.get(c, 1), "long"))
    asked = bounded.select(group.alias("group"), "vec_id", "v").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<long>")))
    return sent, asked


def voronoi_topk(data: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of data by inner product of floor(scale * x).

    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part. Vectors of unequal length meet over the components
    both have. Scores are exact whatever their size; one among the results that
    a long doesn't hold is an error, as is a scaled component beyond a double.
    Repeated rows are candidates of their own, other rows of a query's id are
    not its candidates, and of several query rows of one id the smallest vector
    counts. Fewer than k candidates give fewer rows, an empty table none. Other
    columns play no part.
    """
    made = voronoi_parts(data, is_query, k, id_col, vec_col, scale)
    if made is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sent, asked = made

    def solve(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(rows) and len(asked):
            own = asked["vec_id"].tolist()
            found = best(rows["vec_id"].to_numpy(), matrix(rows["v"].tolist()), matrix(asked["v"].tolist()), asked["vec_id"].to_numpy(), k)
            out = [(q, i, s) for q, f in zip(own, found) for s, i in f]
            if any(s >= -LEAST for _, _, s in out):
                raise OverflowError("a score is beyond a long")
        return pd.DataFrame([(q, i, max(s, LEAST)) for q, i, s in out], columns=["query_id", "vec_id", "score"]).astype("int64")

    found = sent.groupBy("group", "chunk").cogroup(asked.groupBy("group", "chunk")).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.when(F.col("score") > LEAST, F.col("score")).otherwise(F.raise_error(F.lit("a score is beyond a long")).cast("long"))
    return found.select("query_id", "rank", "vec_id", score.alias("score"))


@query
def op5_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
