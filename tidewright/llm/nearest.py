"""Approximate nearest neighbours by anisotropic four-bit quantisation and exact reranking.

Within a cell the distance is smallest where the inner product of the query and
a candidate, both taken from the cell's centre, less half the candidate's
squared length, is largest; so residuals are quantised for inner products, and
adding the same vector to all rows changes nothing.  The direction of each
residual becomes one of 16 codewords for every two dimensions, chosen so that
error along it counts ETA times error across it, as the queries that matter
point where it does.  Two codes make a byte, a query turns the codebooks into
tables of 256 sums, and the best of the table scans over its nearest cells are
measured exactly on the original vectors.

The centres and codebooks are learned from a bounded sample; every vector is
indexed.  Scans shuffle codes, not vectors; those are fetched by id for what is
measured.  Cells are cut into chunks of bounded size, so that a cell with a very
common vector is spread over tasks.  How many cells a query visits is measured
on the table: the true neighbours of some queries are found by brute force, and
the fewest cells are taken that hold RECALL of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm._spark import Scratch, map_batches

#: Vectors to learn from at most, rows a cell is meant to have, cells at most, cells a query visits at least, candidates of a query measured exactly.
SAMPLE, CELL_ROWS, CELLS, PROBES, RERANKED = 20_000, 512, 1024, 24, 250
#: A query's nearest cells that each may give all candidates to be measured, and how many each chunk of another may give.
NEAR_CELLS, FAR_KEPT = 4, 50
#: The share of true neighbours that the visited cells are to hold, and the queries at most that it is measured on.
RECALL, MEASURED = 0.99, 256
#: Bytes of the sample at most, for long vectors.
SAMPLE_BYTES = 24_000_000
#: The inner product, as a share of the largest, above which errors matter; it sets the weight of parallel error.
THRESHOLD = 0.2


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the squared lengths of ``x``."""
    return (centres * centres).sum(1)[None] - 2 * x @ centres.T


def _own(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a block of rows at a time."""
    return np.concatenate([_distances(x[k : k + 2048], centres).argmin(1) for k in range(0, len(x), 2048)]) if len(x) else np.empty(0, np.int64)


@dataclass
class Index:
    centres: np.ndarray
    books: np.ndarray  # pairs of dimensions x 16 x 2
    eta: float

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _own(x, self.centres)

    def residuals(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals to the cells' centres as directions and lengths, so that tight clusters are coded as finely as wide ones."""
        residual = x - self.centres[cells]
        scale = np.linalg.norm(residual, axis=1)
        return residual / np.maximum(scale, 1e-12)[:, None], scale

    def encode(self, x: np.ndarray, cells: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x pairs) by coordinate descent on the anisotropic loss."""
        n, pairs = len(x), len(self.books)
        # The residual's direction is what is coded and what error is parallel to.
        r = u = self.residuals(x, cells)[0].reshape(n, pairs, 2)
        codes = np.zeros((n, pairs), np.uint8)
        off = np.zeros(n)
        for m in range(pairs):
            codes[:, m] = ((r[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1)
            off += ((r[:, m] - self.books[m][codes[:, m]]) * u[:, m]).sum(1)
        for _ in range(sweeps):
            for m in range(pairs):
                error = r[:, m, None] - self.books[m]
                part = (error * u[:, m, None]).sum(2)
                off -= part[np.arange(n), codes[:, m]]
                codes[:, m] = ((error**2).sum(2) + (self.eta - 1) * (off[:, None] + part) ** 2).argmin(1)
                off += part[np.arange(n), codes[:, m]]
        return codes


def learn(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> Index:
    """Centres by k-means and codebooks by alternating anisotropic assignment and least squares; ``x`` has an even number of columns."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _own(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    own = _own(x, centres)
    pairs = x.shape[1] // 2
    books = np.zeros((pairs, 16, 2))
    index = Index(centres, books, max(1.0, (x.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)))
    r = index.residuals(x, own)[0].reshape(len(x), pairs, 2)
    for m in range(pairs):
        book = r[rng.choice(len(r), 16, replace=len(r) < 16), m].copy()
        for _ in range(rounds):
            near = ((r[:, m, None] - book) ** 2).sum(2).argmin(1)
            for k in np.unique(near):
                book[k] = r[near == k, m].mean(0)
        books[m] = book
    u = r
    weight = index.eta - 1
    for _ in range(2):
        codes = index.encode(x, own, 1)
        decoded = np.stack([index.books[m][codes[:, m]] for m in range(pairs)], 1)
        off = ((r - decoded) * u).sum((1, 2))
        for m in range(pairs):
            rest = off - ((r[:, m] - decoded[:, m]) * u[:, m]).sum(1) + (r[:, m] * u[:, m]).sum(1)
            for k in np.unique(codes[:, m]):
                mine = codes[:, m] == k
                a = np.eye(2) * mine.sum() + weight * u[mine, m].T @ u[mine, m]
                index.books[m, k] = np.linalg.solve(a, r[mine, m].sum(0) + weight * (u[mine, m] * rest[mine, None]).sum(0))
            new = index.books[m][codes[:, m]]
            off += ((decoded[:, m] - new) * u[:, m]).sum(1)
            decoded[:, m] = new
    return index


def scan(index: Index, packed: np.ndarray, scale: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Approximate squared distances (queries x rows), less the queries' own squared lengths, of one cell's rows by table lookups.

    ``queries`` are taken from the cell's centre; ``scale`` has the rows' residuals' lengths.
    """
    pairs = index.books.shape[0]
    out = np.empty((len(queries), len(packed)), np.float32)
    low, high = np.arange(256) & 15, np.arange(256) >> 4
    square = (scale * scale).astype(np.float32)
    for k, q in enumerate(queries):
        tables = np.einsum("mkd,md->mk", index.books, q.reshape(pairs, 2)).astype(np.float32)
        total = np.zeros(len(packed), np.float32)
        for b in range(packed.shape[1]):
            two = tables[2 * b][low] + (tables[2 * b + 1][high] if 2 * b + 1 < pairs else 0)
            total += two[packed[:, b]]
        out[k] = square - 2 * scale * total
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([p.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for p in parts]) if parts else np.empty((0, dim))


def _probes_for(coded: DataFrame, index: Index, every: int, k: int) -> int:
    """The fewest cells a query must visit to hold RECALL of the true neighbours, measured by brute force on MEASURED of the queries at most."""
    asking = coded.where(F.col("vec_id") % every == 0).select("vec_id", "v").dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).toArrow()
    if not asking.num_rows:
        return PROBES
    names, queries = asking["vec_id"].to_numpy(), _matrix(asking["v"], index.dim)
    shared = coded.sparkSession.sparkContext.broadcast((names, queries))

    def closest(batch: pa.RecordBatch) -> pa.Table:
        names, queries = shared.value
        ids, x, cells = batch.column(0).to_numpy(), _matrix(batch.column(1), queries.shape[1]), batch.column(2).to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for name, q, row in zip(names, queries, _distances(queries, x), strict=True):
            row[ids == name] = np.inf
            order = np.lexsort((ids, row))
            order = order[np.isfinite(row[order])]
            m = k
            while m < len(order) and len(np.unique(ids[order[:m]])) < k:
                m *= 4
            best = order[:m]
            out.append((np.full(len(best), name), ids[best], cells[best], row[best] + q @ q))
        return pa.table([pa.array(np.concatenate([o[j] for o in out])) for j in range(4)], names=["query_id", "vec_id", "cell", "score"])

    found = map_batches(coded.select("vec_id", "v", "cell"), closest, "query_id long, vec_id long, cell int, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min_by("cell", "score").alias("cell"), F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "cell").toArrow()
    place = np.argsort(np.argsort(_distances(queries, index.centres), axis=1, kind="stable"), axis=1)
    row = {name: j for j, name in enumerate(names.tolist())}
    needed = np.sort([place[row[q], c] + 1 for q, c in zip(found["query_id"].to_pylist(), found["cell"].to_pylist(), strict=True)])
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) if len(needed) else PROBES


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, probes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows with other ids.  Ties go to the smaller id.  A query visits ``probes``
    cells, and more while those hold fewer than ``k`` others; with as few cells
    as probes the scan covers all rows.  By default probes are as many as
    _probes_for() measures on the table, PROBES at least.  Vectors that are null, zero, or have
    null or non-finite components take no part, nor do those whose length isn't
    the commonest one (the longer of equally common ones), nor rows with a null
    id.  Repeated rows of an id are one candidate, at its least distance.
    Without vectors the result is empty.  Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    length, n = lengths[0]
    rows = rows.where(F.size("v") == length)
    if length % 2:
        rows = rows.withColumn("v", F.concat("v", F.array(F.lit(0.0))))
    dim = length + length % 2
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(256, min(sample, SAMPLE_BYTES // (8 * dim)))).select("v").toArrow()
    cells = int(min(max(n // CELL_ROWS, 8), CELLS))
    index = learn(_matrix(drawn["v"], dim), cells)
    shared = spark.sparkContext.broadcast(index)

    def encode(batch: pa.RecordBatch) -> pa.Table:
        index = shared.value
        x = _matrix(batch.column(1), dim)
        own = index.cells(x)
        codes = index.encode(x, own)
        if codes.shape[1] % 2:
            codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
        packed = np.ascontiguousarray(codes[:, ::2] | codes[:, 1::2] << 4)
        width = packed.shape[1]
        binary = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, len(x) * width + 1, width, dtype=np.int32)), pa.py_buffer(packed.tobytes())])
        return pa.table([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), binary, pa.array(index.residuals(x, own)[1].astype(np.float32))], names=["vec_id", "v", "cell", "codes", "scale"])

    coded = scratch.write(map_batches(rows, encode, "vec_id long, v array<double>, cell int, codes binary, scale float"), "codes")
    # A count for each cell, of which there are CELLS at most.
    counts = np.zeros(len(index.centres), np.int64)
    for cell, count in coded.groupBy("cell").count().collect():
        counts[cell] = count
    if probes is None:
        probes = PROBES if len(counts) <= PROBES else max(PROBES, _probes_for(coded, index, every, k))
    chunk_rows = int(min(max(4 * n // max(1, len(counts)), 1024), 1 << 16))
    chunks = np.maximum(1, -(-counts // chunk_rows))
    asked = n / every * probes / len(counts)
    blocks = max(1, round(asked / 4096))

    def visit(batch: pa.RecordBatch) -> pa.Table:
        x = _matrix(batch.column(1), dim)
        order = np.argsort(_distances(x, shared.value.centres), axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        visited = np.maximum(probes, (held <= k).sum(1) + 1)
        query, cell, chunk, kept = [], [], [], []
        for row in range(len(x)):
            for place, c in enumerate(order[row, : visited[row]]):
                if counts[c]:
                    query += [row] * chunks[c]
                    cell += [c] * chunks[c]
                    chunk += range(chunks[c])
                    kept += [RERANKED if place < NEAR_CELLS else max(FAR_KEPT, k)] * chunks[c]
        block = batch.column(0).take(pa.array(query)).to_numpy() // every % blocks
        return pa.table([batch.column(0).take(pa.array(query)), batch.column(1).take(pa.array(query)), pa.array(np.array(cell, np.int32)), pa.array(np.array(chunk, np.int32)), pa.array(block.astype(np.int32)), pa.array(np.array(kept, np.int32))], names=["query_id", "q", "cell", "chunk", "block", "kept"])

    queries = rows.where(F.col("vec_id") % every == 0)
    asking = map_batches(queries, visit, "query_id long, q array<double>, cell int, chunk int, block int, kept int")
    cut = F.element_at(F.array(*[F.lit(int(c)) for c in chunks]), F.col("cell") + 1)
    candidates = coded.select("vec_id", "cell", "codes", "scale").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), cut).cast("int"))
    candidates = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else candidates.withColumn("block", F.lit(0))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            index, cell = shared.value, key[0].as_py()
            left = left.sort_by("vec_id")  # equal scores then keep the smaller ids
            ids, scale = left["vec_id"].to_numpy(), left["scale"].to_numpy()
            packed = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            queries, asked_by, kept = _matrix(right["q"], dim) - index.centres[cell], right["query_id"].to_numpy(), right["kept"].to_numpy()
            repeats = len(np.unique(ids)) < len(ids)
            for a in range(0, len(queries), 64):
                part = slice(a, a + 64)
                for q, name, most, near in zip(queries[part], asked_by[part], kept[part], scan(index, packed, scale, queries[part]), strict=True):
                    near[ids == name] = np.inf
                    if repeats or len(near) <= most:  # rows that repeat an id are one candidate
                        best = np.argsort(near, kind="stable")
                        best = best[np.sort(np.unique(ids[best], return_index=True)[1])] if repeats else best
                    else:
                        edge = np.partition(near, most - 1)[most - 1]
                        best = np.flatnonzero(near <= edge)
                        best = best[np.argsort(near[best], kind="stable")]
                    best = best[:most]
                    best = best[np.isfinite(near[best])]
                    out.append((name, ids[best], (near[best] + q @ q).astype(np.float32)))
        return lists(out)

    def lists(out: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
        ends = pa.array(np.concatenate([[0], np.cumsum([len(i) for _, i, _ in out])]).astype(np.int32))
        ids, near = (np.concatenate([*(o[j] for o in out), np.empty(0, t)]) for j, t in ((1, np.int64), (2, np.float32)))
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(near))], names=["query_id", "ids", "near"])

    def merge(group: pa.Table) -> pa.Table:
        """The nearest RERANKED of all that the chunks gave to a query."""
        ids, near = (np.concatenate([x.flatten().to_numpy() for x in group[c].chunks]) for c in ("ids", "near"))
        best = np.lexsort((ids, near))
        best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:RERANKED]
        return pa.table([pa.array(np.full(len(best), group["query_id"][0].as_py())), pa.array(ids[best])], names=["query_id", "vec_id"])

    key = ["cell", "chunk", "block"]
    found = candidates.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(search, "query_id long, ids array<long>, near array<float>")
    # A query's group holds at most RERANKED candidates for each chunk of NEAR_CELLS cells and FAR_KEPT for each other that it visits.
    found = scratch.write(found.groupBy("query_id").applyInArrow(merge, "query_id long, vec_id long"), "found")
    # The vectors of candidates meet their queries by id.
    theirs = found.join(coded.select("vec_id", "v"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def measure(batch: pa.RecordBatch) -> pa.Table:
        away = _matrix(batch.column(2), dim) - _matrix(batch.column(3), dim)
        return pa.table([batch.column(0), batch.column(1), pa.array(np.sqrt((away * away).sum(1)))], names=["query_id", "vec_id", "score"])

    found = map_batches(theirs.select("query_id", "vec_id", "v", "q"), measure, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
