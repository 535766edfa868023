"""Approximate nearest neighbours with balanced posting lists.

Centroids come from balanced bisection of a bounded sample, so lists are about equally long. They are
searched by best-first walks on an in-memory neighbour graph, and all of them are looked at for a query
that needs more lists than a walk finds (BREADTH). A vector goes to its nearest list and is
replicated to other lists whose centroid is nearly as near (within BOUNDARY) unless a chosen centroid
lies about where theirs does (BETWEEN). A query scans the lists whose centroid is at most PRUNE times as far as the
nearest one, and further ones until these hold enough vectors; their number has no other bound, so where all
centroids are about equally far (unit vectors that point anywhere) a query scans many lists.

Equal vectors are one entry of a list with their k + 1 smallest ids, which is all that any answer
can need; so a vector that a third of the rows share costs no more than another. A list that is
still long is split into salted parts of about PART entries, each searched by a task of its own; of more
than TURN queries, each such part is searched in several turns.

Bounds: at most SAMPLE vectors, MOST_LISTS centroids and SAMPLE_BYTES of either are on the driver and broadcast, whatever
the size of the table and of its vectors; every row is indexed.

Defined results: null vectors, those holding a null or non-finite component, zero vectors and those whose
length is not the commonest (the smaller of equals) take no part; rows with a null id take no part;
of rows with the same id the least vector (component by component) counts; an empty table gives an empty result; only
the columns named are read, so extra columns can't clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written

SAMPLE, SAMPLE_BYTES, LIST, MOST_LISTS, PART, TURN = 65_536, 64 << 20, 128, 16_384, 4096, 1 << 16
#: Links of a centroid, breadth of a query's walk and of a vector's, most lists of a vector, nearness for replicas, and of probed lists.
LINKS, BREADTH, HOME_BREADTH, REPLICAS, BOUNDARY, PRUNE = 24, 96, 16, 2, 1.15, 1.15
#: A centroid is left out for replicas only if a chosen one is nearer to it than this share of its distance to
#: the vector; near 1 no replica is left in many dimensions, where centroids lie nearer to each other than to vectors.
BETWEEN = 0.2
#: Vectors that the probed lists hold at least together, as a multiple of k.
ENOUGH = 40


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, for walks only."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0))


def bisected(points: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of ``lists`` parts of (nearly) equal size: two means, then a cut at the right quantile
    of the difference of the distances to them."""
    out, todo = [], [(points, min(lists, len(points)))]
    while todo:
        part, k = todo.pop()
        if k <= 1:
            out.append(part.mean(axis=0))
            continue
        a = part[((part - part.mean(axis=0)) ** 2).sum(1).argmax()]
        b = part[((part - a) ** 2).sum(1).argmax()]
        for _ in range(6):
            side = part @ (b - a) > (b @ b - a @ a) / 2
            if side.all() or not side.any():
                break
            a, b = part[~side].mean(axis=0), part[side].mean(axis=0)
        cut = min(max(round(len(part) * (k // 2) / k), k // 2), len(part) - (k - k // 2))
        order = np.argsort(part @ (b - a), kind="stable")
        todo += [(part[order[cut:]], k - k // 2), (part[order[:cut]], k // 2)]
    return np.unique(np.array(out), axis=0)


@dataclass
class Index:
    centroids: np.ndarray  # (lists, d) float64
    links: np.ndarray  # (lists, links) of the neighbour graph
    entries: np.ndarray  # where walks start

    @functools.cached_property
    def single(self) -> np.ndarray:
        return self.centroids.astype(np.float32)

    @classmethod
    def over(cls, centroids: np.ndarray) -> Index:
        n = len(centroids)
        near = min(LINKS * 2 // 3, n)
        links = np.empty((n, near + LINKS // 3), np.intp)
        far = np.random.default_rng(0).integers(0, max(n, 1), (n, LINKS // 3))  # long links keep the graph connected
        for i in range(0, n, 512):
            links[i : i + 512, :near] = np.argsort(_distances(centroids[i : i + 512], centroids), axis=1, kind="stable")[:, :near]
        links[:, near:] = far
        return cls(centroids, links, np.unique(np.linspace(0, max(n - 1, 0), min(n, 16)).astype(np.intp)))

    def walk(self, x: np.ndarray, breadth: int = BREADTH) -> tuple[np.ndarray, np.ndarray]:
        """The nearest lists found for each row of x, nearest first, and their distances; -1 and inf fill up."""
        n, m = len(x), len(self.centroids)
        breadth = min(breadth, m)
        found = np.tile(self.entries, (n, 1))
        dist = self._to(x, found)
        seen = np.zeros((n, m), bool)
        np.put_along_axis(seen, found, True, axis=1)
        pad = breadth - found.shape[1]
        if pad > 0:
            found = np.pad(found, ((0, 0), (0, pad)), constant_values=-1)
            dist = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        opened = found < 0
        rows = np.arange(n)
        while len(rows):
            at = np.where(opened[rows], np.inf, dist[rows])
            pick = at.argmin(axis=1)
            go = np.isfinite(at[np.arange(len(rows)), pick])
            rows, pick = rows[go], pick[go]
            if not len(rows):
                break
            opened[rows, pick] = True
            to = self.links[found[rows, pick]]
            new = ~np.take_along_axis(seen[rows], to, axis=1)
            # a link may be listed twice: only its first place counts
            order = np.sort(to, axis=1)
            if (order[:, 1:] == order[:, :-1]).any():
                first = (to[:, :, None] == to[:, None, :]).argmax(axis=2) == np.arange(to.shape[1])
                new &= first
            seen[rows[:, None], to] = True
            d = np.where(new, self._to(x[rows], to), np.inf)
            every = np.concatenate([found[rows], np.where(new, to, -1)], axis=1)
            far = np.concatenate([dist[rows], d], axis=1)
            done = np.concatenate([opened[rows], ~new], axis=1)
            best = np.argsort(far, axis=1, kind="stable")[:, : found.shape[1]]
            found[rows], dist[rows], opened[rows] = (np.take_along_axis(v, best, axis=1) for v in (every, far, done))
        order = np.argsort(dist, axis=1, kind="stable")[:, :breadth]
        return np.take_along_axis(found, order, axis=1), np.take_along_axis(dist, order, axis=1)

    def _to(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """In single precision, which is enough to choose lists."""
        near = self.single[lists]
        near -= x[:, None, :].astype(np.float32)
        return np.sqrt(np.einsum("ijk,ijk->ij", near, near))

    def homes(self, x: np.ndarray) -> Iterator[list[int]]:
        """The lists of each vector, found by a walk."""
        for ids, d in zip(*(f.tolist() for f in self.walk(x, HOME_BREADTH)), strict=True):
            mine = [ids[0]]
            for c, far in zip(ids[1:], d[1:], strict=True):
                if c < 0 or far > BOUNDARY * d[0] or len(mine) >= REPLICAS:
                    break
                if all(((self.centroids[c] - self.centroids[o]) ** 2).sum() >= (BETWEEN * far) ** 2 for o in mine):
                    mine.append(c)
            yield mine

    def probes(self, x: np.ndarray, sizes: np.ndarray, enough: int) -> list[np.ndarray]:
        """The lists that each query scans, nearest first."""
        found, dist = self.walk(x)
        out = self._scanned(found, dist, sizes, enough)
        more = [i for i, lists in enumerate(out) if found.shape[1] == len(lists) < len(self.centroids)]
        for i in range(0, len(more), 64):  # the walk ended before the ratio did
            far = _distances(x[more[i : i + 64]], self.centroids)
            order = np.argsort(far, axis=1, kind="stable")
            for q, lists in zip(more[i : i + 64], self._scanned(order, np.take_along_axis(far, order, axis=1), sizes, enough), strict=True):
                out[q] = lists
        return out

    @staticmethod
    def _scanned(found: np.ndarray, dist: np.ndarray, sizes: np.ndarray, enough: int) -> list[np.ndarray]:
        held = np.where(found < 0, 0, sizes[found])
        take = (found >= 0) & ((dist <= PRUNE * dist[:, :1]) | (held.cumsum(axis=1) - held < enough))
        return [lists[t] for lists, t in zip(found, take, strict=True)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _valid(x: Column) -> Column:
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row per vector: rep (its smallest id), embedding, ids (the k + 1 smallest)."""
    within = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(within)).where(f"n <= {k + 1}")  # also cut before the shuffle
    return kept.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "embedding", "ids")


def prepared(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, embedding (array<float or double>, without negative zeros) of the rows that take part."""
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where(F.col("vec_id").isNotNull() & _valid(F.col("embedding")))
    common = rows.groupBy(F.size("embedding").alias("d")).count().sort(F.desc("count"), "d").first()
    kind = df.schema[vector].dataType.simpleString()
    same = rows.where(F.size("embedding") == (common["d"] if common else 0))
    return same.select("vec_id", F.transform("embedding", lambda v: F.when(v == 0, F.lit(0)).otherwise(v)).cast(kind).alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # rep of the query, vec_id, distance


def _best(reps: np.ndarray, x: np.ndarray, m: np.ndarray, count: np.ndarray, ids: np.ndarray, k: int) -> Found:
    """The k + 1 nearest for each row of x among the entries m; each entry has count of the ids."""
    begin, square, out = np.cumsum(count) - count, (m * m).sum(axis=1), []
    step = max(1, (4 << 20) // m.size)
    for i in range(0, len(x), step):
        q = x[i : i + step]
        # a product tells which entries may be among the nearest; their distances come from differences
        own = (q * q).sum(axis=1)
        rough = own[:, None] - 2 * q @ m.T + square
        limit = np.partition(rough, k, axis=1)[:, k] + 1e-9 * (own + square.max()) if len(m) > k + 1 else np.full(len(q), np.inf)
        row, entry = np.nonzero(~(rough > limit[:, None]))
        far, times = np.sqrt(((q[row] - m[entry]) ** 2).sum(axis=1)), count[entry]
        who = ids[np.arange(times.sum()) + np.repeat(begin[entry] - np.cumsum(times) + times, times)]
        out.append(_merged([(reps[i + np.repeat(row, times)], who, np.repeat(far, times))], k))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _merged(found: list[Found], k: int) -> Found:
    """The k + 1 nearest of each query; a vector found in several lists counts once."""
    rep, who, far = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((who, far, rep))
    rep, who, far = rep[order], who[order], far[order]
    first = np.append(True, (rep[1:] != rep[:-1]) | (who[1:] != who[:-1]))[: len(rep)]
    rep, who, far = rep[first], who[first], far[first]
    best = np.arange(len(rep)) - np.searchsorted(rep, rep) <= k
    return rep[best], who[best], far[best]


def _answers(found: list[Found], k: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in _merged(found, k)], names=["rep", "vec_id", "score"])


def search(df: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where ``queries`` (a condition
    on vec_id) holds, without itself; score is the Euclidean distance in double precision."""
    spark = df.sparkSession
    rows = written(prepared(df, id, vector), "ann-rows")
    kind = rows.schema["embedding"].dataType.simpleString()
    vectors = written(distinct_vectors(rows, k), "ann-vectors")
    n = vectors.count()
    dim = len(vectors.first()["embedding"]) if n else 1
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    spot = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    drawn = vectors.where(spot < int(min(1.0, most / max(n, 1)) * (1 << 30)) + 1).select("embedding").limit(most + most // 8)
    sample = drawn.toArrow().column(0).combine_chunks()
    if n and not len(sample):
        sample = vectors.select("embedding").limit(most).toArrow().column(0).combine_chunks()
    points = np.unique(_matrix(sample, dim), axis=0)  # its order does not hang on that of the rows
    index = Index.over(bisected(points, max(1, min(n // LIST, MOST_LISTS, most)))) if len(points) else Index.over(np.zeros((1, 1)))
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                homes = [*shared.value.homes(_matrix(part.column("embedding"), dim))]
                take = pa.array(np.repeat(np.arange(len(homes)), [len(h) for h in homes]))
                copies = part.take(take)
                yield pa.record_batch([pa.array([c for h in homes for c in h], pa.int32()), *copies.columns], names=["list", *part.schema.names])

    postings = written(vectors.mapInArrow(assign, f"list int, rep bigint, embedding {kind}, ids array<bigint>"), "ann-lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in postings.groupBy("list").count().collect():  # as many rows as lists
        sizes[r[0]] = r[1]
    parts = np.maximum(1, -(-sizes // PART))
    parts_of = spark.sparkContext.broadcast((sizes, parts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                chunk = batch.slice(i, 256)
                sizes, parts = parts_of.value
                goes = shared.value.probes(_matrix(chunk.column("embedding"), dim), sizes, ENOUGH * k)
                lists, of = np.concatenate(goes), np.repeat(np.arange(len(goes)), [len(g) for g in goes])
                times = parts[lists]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                lists, of = np.repeat(lists, times), np.repeat(of, times)
                for j in range(0, len(of), 1 << 14):
                    copies = chunk.take(pa.array(of[j : j + (1 << 14)]))
                    yield pa.record_batch([pa.array(lists[j : j + (1 << 14)], pa.int32()), pa.array(part[j : j + (1 << 14)], pa.int32()), *copies.columns], names=["list", "part", *chunk.schema.names])

    asked = rows.where(queries).join(vectors.select("rep", F.col("embedding").alias("_e")), F.col("embedding") == F.col("_e")).select(F.col("vec_id").alias("query_id"), "rep", "embedding")
    asked = written(asked, "ann-queries")
    sent = asked.groupBy("rep").agg(F.first("embedding").alias("embedding")).mapInArrow(probe, f"list int, part int, rep bigint, embedding {kind}")
    turns = max(1, -(-asked.count() // TURN))
    sent = sent.withColumn("turn", F.pmod(F.xxhash64("rep"), F.lit(turns)).cast("int"))
    part_count = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1) if parts.max() > 1 else F.lit(1)
    held = postings.withColumn("part", F.pmod(F.xxhash64("rep"), part_count).cast("int"))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))) if turns > 1 else F.lit(0))
    place = ["turn", "list", "part", "asks"]
    both = held.withColumn("asks", F.lit(False)).select(*place, "rep", "embedding", "ids").unionByName(sent.withColumn("asks", F.lit(True)).withColumn("ids", F.lit(None).cast("array<bigint>")).select(*place, "rep", "embedding", "ids"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 nearest of each query among the lists of a task. A list's entries come before its queries."""
        last, members, best, new = (-1, -1, -1), [], [], 0
        for batch in batches:
            turn, lists, part, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in place)
            change = (np.diff(turn) != 0) | (np.diff(lists) != 0) | (np.diff(part) != 0) | (asks[1:] != asks[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = int(turn[a]), int(lists[a]), int(part[a])
                if key != last:
                    if key[0] != last[0] and best:
                        yield _answers(best, k)
                        best, new = [], 0
                    last, members = key, []
                run = batch.slice(a, b - a)
                vectors, reps = _matrix(run.column("embedding"), dim), run.column("rep").to_numpy()
                if not asks[a]:
                    ids = run.column("ids")
                    members.append((vectors, np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()))
                elif members:
                    members = [tuple(map(np.concatenate, zip(*members, strict=True)))]
                    best.append(_best(reps, vectors, *members[0], k))
                    new += len(best[-1][0])
                    if new > 1 << 20:
                        best, new = [_merged(best, k)], 0
        if best:
            yield _answers(best, k)

    found = both.repartition("turn", "list", "part").sortWithinPartitions(*place).mapInArrow(nearest, "rep bigint, vec_id bigint, score double")
    by_rep = Window.partitionBy("rep").orderBy("score", "vec_id")
    top = found.dropDuplicates(["rep", "vec_id"]).withColumn("n", F.row_number().over(by_rep)).where(f"n <= {k + 1}").drop("n")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    answers = asked.select("query_id", "rep").join(top, "rep").where("vec_id <> query_id")
    return answers.withColumn("rank", F.row_number().over(by_query)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
