"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors are rotated to the eigenvectors of their Gram matrix (the right
singular vectors of the table), so their first coordinates carry most of every
product.  Candidates are stored by descending length.  A task adds up the
first coordinates and bounds the rest by Cauchy-Schwarz; a candidate whose
bound misses a query's k-th score so far is skipped, and once the product of
lengths misses it all later ones are.  What remains is scored exactly in
integers, as one matrix product where most of a tile remains.  The first thresholds come from the longest vectors.

Queries are written to the shared folder in blocks of bounded size, with their first
thresholds.  One pass over the candidates serves all of them: a task holds one range of
candidates, about ``RANGE`` bytes, and meets the blocks one by one.  What is broadcast is the rotation
and the ``SEEDS`` longest vectors.

Defined cases: vectors that are null or hold a null, NaN or infinite component
take no part, nor do those with a null id; vectors of different lengths are
filled up with zeros; ties go to the smaller id; repeated rows are candidates
each, as a query an id counts once, with its least vector; extra columns are
ignored; scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, staged, table

QUERY_BLOCK = 4096
#: Bytes of the candidates of a task, about.
RANGE = 1 << 25
SEEDS = 2048
HEAD = 16
STEP = 1024
#: a tile with a larger share than 1 / DENSE of its pairs open is multiplied whole
DENSE = 64
PAIRS = 1 << 16
SCALE = 64


def integer_vectors(vectors: DataFrame, scale: int = SCALE, query_mod: int = 20) -> DataFrame:
    """(vec_id, v, norm, dims, is_query): floor(scale * x) as doubles in bytes, of rows that take part."""

    def run(batches):
        for batch in batches:
            ids, vs, norms, dims = [], [], [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.floor(x.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.isfinite(v).all():
                    ids.append(i)
                    vs.append((v + 0.0).tobytes())
                    norms.append(float(np.sqrt((v * v).sum())))
                    dims.append(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary()), pa.array(norms, pa.float64()), pa.array(dims, pa.int32())], ["vec_id", "v", "norm", "dims"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, v binary, norm double, dims int").withColumn("is_query", F.col("vec_id") % query_mod == 0)


def _stack(column: pa.Array, d: int) -> np.ndarray:
    rows = [np.frombuffer(x.as_buffer(), np.float64) for x in column]
    if all(len(r) == d for r in rows):
        return np.array(rows).reshape(len(rows), d)
    out = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthogonal matrix of the table's right singular vectors, large ones first."""

    def run(batches):
        gram = np.zeros((d, d))
        for batch in batches:
            x = _stack(batch.column("v"), d)
            gram += x.T @ x
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, i), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(gram[i])], ["i", "j", "g"])

    got = vectors.select("v").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    gram = np.zeros((d, d))
    gram[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("g").to_numpy()
    top = max(1.0, np.abs(gram).max())
    return np.linalg.eigh(np.nan_to_num(gram / top))[1][:, ::-1].copy()


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products of doubles that hold integers."""
    most = (np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, s)) for r, s in zip(q, x)], np.int64)


class _Best:
    """The k best (score, id) of each query so far; ``turn`` rotates the queries once."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, turn: np.ndarray, head: int):
        self.q, self.ids, self.k = queries, ids, k
        self.turn, self.head = turn, head
        self.q_norm = np.sqrt((queries * queries).sum(axis=1))
        self.q_head = _with_rest(queries @ turn, head)
        self.owner = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.vec = np.zeros(0, np.int64)
        self.floor = floor.copy()

    def add(self, owner: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, vec = np.concatenate((self.owner, owner)), np.concatenate((self.score, score)), np.concatenate((self.vec, vec))
        order = np.lexsort((vec, -score, owner))
        owner, score, vec = owner[order], score[order], vec[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[owner[last]] = np.maximum(self.floor[owner[last]], score[last])
        self.owner, self.score, self.vec = owner[keep], score[keep], vec[keep]


def _with_rest(rotated: np.ndarray, head: int) -> np.ndarray:
    """The first coordinates and, as one more, the length of the others.

    The product of two such rows is the partial sum plus the Cauchy-Schwarz bound of the rest.
    """
    rest = np.sqrt((rotated[:, head:] ** 2).sum(axis=1))
    return np.concatenate((rotated[:, :head], rest[:, None]), axis=1)


class _Candidates:
    """Vectors, longest first, with their rotated heads."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, norms: np.ndarray, turn: np.ndarray, head: int):
        order = np.argsort(-norms, kind="stable")
        self.x, self.ids, self.norms = x[order], ids[order], norms[order]
        self.head = np.concatenate([_with_rest(self.x[lo : lo + 8 * STEP] @ turn, head) for lo in range(0, max(1, len(x)), 8 * STEP)])


def _scan(best: _Best, own: _Candidates) -> None:
    """Lets ``best`` meet the candidates, longest first."""
    for lo in range(0, len(own.x), STEP):
        slack = 1e-9 * best.q_norm * own.norms[lo] + 0.5
        live = np.flatnonzero(best.q_norm * own.norms[lo] + slack >= best.floor)
        if not len(live):
            return  # all later ones are no longer
        part = slice(lo, lo + STEP)
        for at in range(0, len(live), STEP):
            _tile(best, live[at : at + STEP], slack, own.x[part], own.head[part], own.ids[part])


def _tile(best: _Best, live: np.ndarray, slack: np.ndarray, x: np.ndarray, x_head: np.ndarray, ids: np.ndarray) -> None:
    """Scores the pairs of some queries and candidates whose bound meets the query's floor."""
    open_ = best.q_head[live] @ x_head.T >= (best.floor[live] - slack[live])[:, None]
    rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return
    live, x, ids, open_ = live[rows], x[columns], ids[columns], open_[np.ix_(rows, columns)]
    q = best.q[live]
    most = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[1]
    if most < 2.0**53 and np.count_nonzero(open_) * DENSE >= open_.size:
        # many pairs are open: one product of integers, exact in doubles, costs less than picking them
        scores = q @ x.T
        a, b = np.nonzero(open_ & (scores >= best.floor[live][:, None]))
        s = scores[a, b].astype(np.int64)
    else:
        a, b = np.nonzero(open_)
        s = np.concatenate([exact_scores(q[a[c : c + PAIRS]], x[b[c : c + PAIRS]]) for c in range(0, len(a), PAIRS)])
    good = (s >= best.floor[live[a]]) & (best.ids[live[a]] != ids[b])
    best.add(live[a[good]], s[good], ids[b[good]])


def write_queries(queries: DataFrame, folder: str, k: int, d: int, head: int, turn, seeds, block: int) -> list[str]:
    """Paths of blocks of queries (vec_id, v) and the floors that ``seeds`` give them; tasks write them."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        longest = _Candidates(*seeds.value, turn.value, head)
        ids: list[int] = []
        vs: list[bytes] = []
        for last in (False, True):
            for batch in () if last else batches:
                ids += batch.column("vec_id").to_pylist()
                vs += batch.column("v").to_pylist()
                if len(ids) >= block:
                    yield from put(fs, root, longest, ids, vs, len(ids) // block * block)
            if last and ids:
                yield from put(fs, root, longest, ids, vs, len(ids))

    def put(fs, root, longest, ids, vs, n):
        for lo in range(0, n, block):
            hi = min(n, lo + block)
            q, qid = _stack(pa.array(vs[lo:hi], pa.binary()), d), np.array(ids[lo:hi], np.int64)
            first = _Best(q, qid, k, np.full(len(qid), -np.inf), turn.value, head)
            _scan(first, longest)
            body, path = io.BytesIO(), f"{root}/{uuid.uuid4().hex}"
            np.savez(body, q=q, qid=qid, floor=first.floor)
            with fs.open_output_stream(path, compression=None) as out:
                out.write(body.getbuffer())
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])
        del ids[:n], vs[:n]

    return sorted(r["path"] for r in staged(queries.mapInArrow(run, "path string"), "query-manifest").collect())  # one row a block


def top_k(vectors: DataFrame, k: int = 20, scale: int = SCALE, query_mod: int = 20, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest products of each vector whose id ``query_mod`` divides."""
    spark = vectors.sparkSession
    own = staged(integer_vectors(vectors, scale, query_mod), "integers")
    d, rows = own.agg(F.max("dims"), F.count("*")).first()
    queries = own.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    head = min(HEAD, d)
    turn = spark.sparkContext.broadcast(rotation(own, d))
    longest = own.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v", "norm").toArrow()
    seeds = spark.sparkContext.broadcast((_stack(longest.column("v").combine_chunks(), d), longest.column("vec_id").to_numpy(), longest.column("norm").to_numpy()))
    folder = fresh_path(spark, "queries")
    paths = write_queries(queries, folder, k, d, head, turn, seeds, query_block)

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        parts = [(_stack(b.column("v"), d), b.column("vec_id").to_numpy(), b.column("norm").to_numpy()) for b in batches if len(b)]
        if not parts:
            return
        mine = _Candidates(*map(np.concatenate, zip(*parts)), turn.value, head)
        for path in paths:
            with fs.open_input_stream(path, compression=None) as source:
                held = np.load(io.BytesIO(source.read()))
            best = _Best(held["q"], held["qid"], k, held["floor"], turn.value, head)
            _scan(best, mine)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (best.ids[best.owner], best.vec, best.score)], ["query_id", "vec_id", "score"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * d * 8 // RANGE))
    # ids break ties of length, so equal vectors spread over the ranges
    ranges = own.select("vec_id", "v", "norm").repartitionByRange(n, F.desc("norm"), "vec_id")
    found = ranges.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
