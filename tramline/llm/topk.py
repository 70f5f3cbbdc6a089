"""Exact top-k inner products with norm order and residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
NORM_BUCKETS = 64
CHUNK = 512
FOUND = "query_row long, vec_id long, score long"
TOP = "query_id long, rank int, vec_id long, score long"
#: Below this product of lengths every partial sum of a product is a whole number that a double holds.
DOUBLE_EXACT, LONG_EXACT = 2.0**53, 2.0**62
LONG_MAX = 2**63 - 1


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component, whole numbers of any size.

    Rows with a null id, a null vector, or a component that is null, not
    finite, or no longer finite after scaling are left out.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    # floor() of a double gives a long, which large components don't fit; beyond 2^52 doubles are whole
    whole = F.transform(v, lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
        .select("vec_id", whole.alias("v"))
    )


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k highest integer inner products of each query row among all other rows.

    vectors has vec_id and v (array<double> of whole numbers), as quantized()
    gives; is_query is a condition on vec_id. Returns query_id, rank (from
    1), vec_id, score; ties go to the smaller vec_id; fewer rows if there are
    fewer candidates. Shorter vectors count as padded with zeros. Rows, not
    ids, are queries and candidates: a vec_id that repeats has a list of its
    own for each of its rows, in which its other rows may occur. Scores are
    exact; one beyond the range of a long counts as the nearest long. Null ids
    and vectors take no part. Empty in, empty out; other columns are ignored.

    Candidates are cut into blocks by falling length. The block of longest
    vectors gives each query a first bound on its k-th score, which says how
    long a vector must be to matter to it (Cauchy-Schwarz). Queries of about
    equal need form a part, and a part meets only the blocks of vectors that
    are long enough for it. Inside, vectors are rotated onto the singular
    vectors of the whole table, and partial sums plus the product of the
    remainders' lengths rule most candidates out before exact products.
    """
    spark = vectors.sparkSession
    usable = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    sized = usable.withColumns(
        {
            "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)),
            "row": F.monotonically_increasing_id(),
        }
    )
    base = materialize(sized, "topk-base")
    n, dim = base.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], TOP)
    rotation = _rotation(base, dim)
    want = min(NORM_BUCKETS, -(-n // BLOCK_ROWS))
    cuts = _cuts(base, "norm", want)
    bucketed = base.withColumn("bucket", _bucket("norm", cuts))
    sizes = {r["bucket"]: r for r in bucketed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    first, pieces, tops = [], [], []
    for b in range(len(cuts) + 1):
        first.append(sum(pieces))
        pieces.append(-(-sizes[b]["n"] // BLOCK_ROWS) if b in sizes else 0)
        tops += [float(sizes[b]["top"]) if b in sizes else 0.0]

    def of(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("bucket") + 1)

    candidates = materialize(
        bucketed.withColumn("block", of(first, "int") + F.pmod(F.xxhash64("row"), of(pieces, "int")).cast("int"))
        .select("block", "row", "vec_id", "v"),
        "topk-candidates",
    )
    queries = materialize(base.where(is_query).select("row", "vec_id", "v", "norm"), "topk-queries")
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    unbounded = queries.withColumns(
        {"part": F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"), "tau": F.lit(None).cast("long")}
    )
    # written first, so that its block is a column to join on and not a constant
    opening = materialize(unbounded.select("part").distinct().withColumn("block", F.lit(0)), "topk-opening")
    seed = materialize(_scanned(unbounded, candidates, opening, rotation, k), "topk-seed")
    bound = seed.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("tau"))
    need = F.when(F.col("tau") > 0, F.col("tau") / F.greatest("norm", F.lit(1.0))).otherwise(0.0)
    needy = queries.join(bound.where(F.col("n") >= k).drop("n"), "row", "left").withColumn("need", F.coalesce(need, F.lit(0.0)))
    needy = materialize(needy, "topk-bounded")
    ranges = _cuts(needy, "need", parts)
    slices = -(-parts // (len(ranges) + 1))  # several where many queries have the same need
    part = _bucket("need", ranges) * slices + F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")
    bounded = needy.withColumn("part", part)
    rows = F.array(*[F.struct(F.lit(f).alias("first"), F.lit(p).alias("n"), F.lit(t).alias("top")) for f, p, t in zip(first, pieces, tops, strict=True)])
    last = F.aggregate(rows, F.lit(0), lambda a, r: F.when(r["top"] * (1 + 1e-9) >= F.col("need"), F.greatest(a, r["first"] + r["n"])).otherwise(a))
    cells = bounded.groupBy("part").agg(F.min("need").alias("need")).withColumn("last", last).where("last > 1")
    cells = materialize(cells.select("part", F.explode(F.sequence(F.lit(1), F.col("last") - 1)).alias("block")), "topk-cells")
    rest = _scanned(bounded, candidates, cells, rotation, k)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    best = seed.unionByName(rest).withColumn("rank", place).where(F.col("rank") <= k)
    names = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query_row").select("query_id", "rank", "vec_id", "score")


def _cuts(df: DataFrame, column: str, parts: int) -> list[float]:
    """At most parts - 1 values that cut df into about equal parts."""
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(column, shares, 0.01))) if shares else []


def _bucket(column: str, cuts: list[float]) -> Column:
    """How many cuts a value doesn't exceed: 0 for the largest values."""
    levels = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(levels, lambda c: c >= F.col(column)))


def _rotation(base: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the table, strongest first, from its Gram matrix.

    Any rotation gives right results, so one that overflows is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            with np.errstate(over="ignore", invalid="ignore"):
                gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(gram.ravel())], ["cell", "x"])

    sums = base.select("v").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    gram = np.zeros(dim * dim)
    for row in sums.toLocalIterator():  # dim * dim rows at any size of the table
        gram[row["cell"]] = row["x"]
    if not np.isfinite(gram).all():
        return np.eye(dim)
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1] if dim else np.zeros((0, 0))


def _matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists as rows, short ones padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _scanned(queries: DataFrame, candidates: DataFrame, cells: DataFrame, rotation: np.ndarray, k: int) -> DataFrame:
    """Up to k best candidates of each query in each cell (part, block) that reach tau."""
    q = queries.join(cells, "part").select("part", "block", "row", "v", "tau")
    c = candidates.join(cells, "block").select(F.col("part").alias("to_part"), F.col("block").alias("to_block"), "row", "vec_id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        dim = len(rotation)
        found = scan_block(
            left["row"].to_numpy(),
            _matrix(left["v"], dim),
            [None if t is None else t for t in left["tau"].to_pylist()],
            right["row"].to_numpy(),
            right["vec_id"].to_numpy(),
            _matrix(right["v"], dim),
            rotation,
            k,
        )
        return pa.table(dict(zip(("query_row", "vec_id", "score"), map(pa.array, found), strict=True)))

    return q.groupBy("part", "block").cogroup(c.groupBy("to_part", "to_block")).applyInArrow(run, FOUND)


def exact_products(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row by row inner products of whole numbers as longs, beyond their range the nearest one.

    lengths is a bound on each product's sum of magnitudes (the rows' norms
    multiplied): it tells which arithmetic is exact.
    """
    out = np.zeros(len(a), np.int64)
    easy = lengths < DOUBLE_EXACT
    out[easy] = np.einsum("ij,ij->i", a[easy], b[easy]).astype(np.int64)
    fits = ~easy & (lengths < LONG_EXACT) & (np.abs(a).max(1, initial=0) < LONG_EXACT) & (np.abs(b).max(1, initial=0) < LONG_EXACT)
    out[fits] = np.einsum("ij,ij->i", a[fits].astype(np.int64), b[fits].astype(np.int64))
    for i in np.flatnonzero(~easy & ~fits):
        whole = sum(int(x) * int(y) for x, y in zip(a[i], b[i], strict=True))
        out[i] = max(-LONG_MAX - 1, min(LONG_MAX, whole))
    return out


def scan_block(
    query_rows: np.ndarray,
    q: np.ndarray,
    least: list[int | None],
    rows: np.ndarray,
    vec_ids: np.ndarray,
    c: np.ndarray,
    rotation: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_row, vec_id, score) of each query's up to k best candidates with a score of at least its least."""
    empty = np.zeros(0, np.int64)
    best_q, best_v, best_s = empty, empty, empty
    if not len(q) or not len(c):
        return empty, empty, empty
    with np.errstate(over="ignore", invalid="ignore"):
        q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
        order = np.argsort(-c_norm, kind="stable")
        c, c_norm, rows, vec_ids = c[order], c_norm[order], rows[order], vec_ids[order]
        q_rot, c_rot = q @ rotation, c @ rotation
        heads = sorted({max(1, len(rotation) // part) for part in (4, 2)})
        q_rest, c_rest = ([np.linalg.norm(x[:, h:], axis=1) for h in heads] for x in (q_rot, c_rot))
        slack = 1e-9 * (1 + q_norm * c_norm[0])
        known = np.array([t is not None for t in least], bool)
        tau = np.array([t or 0 for t in least], np.int64)
        for at in range(0, len(c), CHUNK):
            reach = np.where(known, tau.astype(float), -np.inf)
            if not (~(q_norm * c_norm[at] + slack < reach)).any():
                break  # no later vector is longer
            some, head = slice(at, at + CHUNK), heads[0]
            bound = q_rot[:, :head] @ c_rot[some, :head].T + q_rest[0][:, None] * c_rest[0][None, some] + slack[:, None]
            # not a number (lengths beyond a double) rules nothing out
            i, j = np.nonzero(~(bound < reach[:, None]) & (query_rows[:, None] != rows[None, some]))
            if 16 * len(i) > bound.size and q_norm.max() * c_norm[at] < DOUBLE_EXACT:
                score = (q @ c[some].T)[i, j].astype(np.int64)  # many are left: all products at once
            else:
                more = np.einsum("ij,ij->i", q_rot[i, : heads[-1]], c_rot[at + j, : heads[-1]])
                near = ~(more + q_rest[-1][i] * c_rest[-1][at + j] + slack[i] < reach[i])
                i, j = i[near], j[near]
                lengths, score = q_norm[i] * c_norm[at + j], np.zeros(len(i), np.int64)
                for start in range(0, len(i), 1 << 16):
                    piece = slice(start, start + (1 << 16))
                    score[piece] = exact_products(q[i[piece]], c[at + j[piece]], lengths[piece])
            good = ~known[i] | (score >= tau[i])
            i, j, score = i[good], j[good], score[good]
            if not len(i):
                continue
            all_q, all_v, all_s = np.append(best_q, i), np.append(best_v, vec_ids[at + j]), np.append(best_s, score)
            rank = np.lexsort((all_v, ~all_s, all_q))
            all_q, all_v, all_s = all_q[rank], all_v[rank], all_s[rank]
            begins = np.searchsorted(all_q, np.arange(len(q)))
            nth = np.arange(len(all_q)) - begins[all_q]
            keep, kth = nth < k, nth == k - 1
            at_k = all_q[kth]
            tau[at_k] = np.where(known[at_k], np.maximum(tau[at_k], all_s[kth]), all_s[kth])
            known[at_k] = True
            best_q, best_v, best_s = all_q[keep], all_v[keep], all_s[keep]
    return query_rows[best_q], best_v, best_s
