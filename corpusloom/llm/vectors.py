"""Embedding near-dedup by int8 tiles, and exact top-k by branch and bound.

Both operators deal the vectors into blocks by a hash of the row and hand every
pair of blocks that must meet to one task. A block grows with the counted rows up
to the number that BYTES holds, so a row is copied about PARTS times while a label
fits PARTS such blocks, and rows / block times beyond that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import connected_components, materialize

#: Fewest vectors in a block, blocks that a label is cut into from then on, and bytes of
#: doubles that a block holds at most.
TILE, PARTS, BYTES = 2048, 12, 16 << 20
#: The same least numbers for the queries and the candidates of the search.
QUERIES, CANDIDATES = 2048, 8192
#: Entries of a product that are in memory at once.
STEP = 2_000_000
#: Room for rounding in the double-precision bounds.
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls and of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _blocks(rows: F.Column, dim: F.Column, least: int) -> F.Column:
    """The number of blocks for so many rows of vectors of `dim` components."""
    most = F.greatest(F.lit(least), F.floor(F.lit(BYTES // 8) / dim))
    return F.ceil(rows / F.least(most, F.greatest(F.lit(least), F.ceil(rows / PARTS)))).cast("int")


def _usable(vec: str) -> F.Column:
    """Not null or empty, and without null or non-finite components."""
    return F.expr(f"{vec} is not null and size({vec}) > 0 and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


class Quantised:
    """Unit vectors as int8 codes: x = scale * code + error, with the norms of both parts."""

    def __init__(self, unit: np.ndarray) -> None:
        top = np.abs(unit).max(axis=1, keepdims=True)
        self.scale = np.where(top > 0, top / 127.0, 1.0)
        self.code = np.rint(unit / self.scale).astype(np.int8)
        near = self.scale * self.code
        self.scale = self.scale[:, 0]
        self.norm = np.sqrt((near**2).sum(axis=1))
        self.error = np.sqrt(((unit - near) ** 2).sum(axis=1))


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows times a power of two each, so that no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Index pairs (i, j) of rows of `a` and `b` with cosine >= threshold, some at a time;
    i < j if `same`.

    The int8 product of a pair differs from its cosine by no more than
    |x'||e_y| + |e_x||y'| + |e_x||e_y|, x' being the decoded vector and e its error.
    Pairs that may reach the threshold within this bound are computed again in
    double precision. Integer products are exact: BLAS adds them in a float type
    whose mantissa holds every partial sum.
    """
    a, b = scaled(a), scaled(b)
    na, nb = np.sqrt((a**2).sum(axis=1)), np.sqrt((b**2).sum(axis=1))
    qa, qb = Quantised(a / na[:, None]), Quantised(b / nb[:, None])
    exact = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64
    right = qb.code.astype(exact).T
    step = max(1, STEP // max(1, len(b)))
    for lo in range(0, len(a), step):
        s = slice(lo, lo + step)
        reach = (qa.code[s].astype(exact) @ right).astype(np.float64)
        reach *= qa.scale[s, None] * qb.scale[None, :]
        reach += qa.norm[s, None] * qb.error[None, :] + qa.error[s, None] * (qb.norm + qb.error)[None, :]
        i, j = np.nonzero(reach >= threshold - SLACK)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 200_000):
            x, y = i[at : at + 200_000], j[at : at + 200_000]
            keep = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            yield x[keep], y[keep]


def lower(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the groups of x and y in `root`, which holds the smallest member for each."""
    while True:
        u, v = root[x], root[y]
        apart = u != v
        if not apart.any():
            return
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _own(ids: np.ndarray, a: np.ndarray, threshold: float) -> np.ndarray:
    """For each row, the rows of its own id (itself too) among those it is linked with."""
    out = np.ones(len(ids), dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    cut = np.flatnonzero(np.diff(ids[order])) + 1
    for rows in np.split(order, cut):
        if len(rows) > 1:
            kinds, at, n = np.unique(a[rows], axis=0, return_inverse=True, return_counts=True)
            at, with_ = at.ravel(), n.copy()
            for x, y in tile_links(kinds, kinds, threshold, True):
                np.add.at(with_, x, n[y])
                np.add.at(with_, y, n[x])
            out[rows] = with_[at]
    return out


def tile_groups(ids: np.ndarray, a: np.ndarray, n_a: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of a tile: the first n_a rows are one block, the rest the
    other; without a rest, the block meets itself. links: rows of other ids that a row is
    linked with in this tile. root: a row of its group. Equal vectors are compared once."""
    one = n_a == len(ids)
    sides = [np.arange(n_a)] if one else [np.arange(n_a), np.arange(n_a, len(ids))]
    kinds = [np.unique(a[rows], axis=0, return_index=True, return_inverse=True, return_counts=True) for rows in sides]
    first = [rows[k[1]] for rows, k in zip(sides, kinds, strict=True)]
    links = [k[3].astype(np.int64) if one else np.zeros(len(k[0]), dtype=np.int64) for k in kinds]
    root = np.arange(len(ids))
    for x, y in tile_links(kinds[0][0], kinds[-1][0], threshold, one):
        np.add.at(links[0], x, kinds[-1][3][y])
        np.add.at(links[-1], y, kinds[0][3][x])
        lower(root, first[0][x], first[-1][y])
    out = np.concatenate([n[k[2].ravel()] for n, k in zip(links, kinds, strict=True)])
    for rows, k, f in zip(sides, kinds, first, strict=True):
        has = out[rows] > 0
        lower(root, rows[has], f[k[2].ravel()][has])
    if one:
        out -= _own(ids, a, threshold)
    elif len(np.intersect1d(ids[:n_a], ids[n_a:])):  # an id with rows in both blocks
        both = np.intersect1d(ids[:n_a], ids[n_a:])
        for i in both.tolist():
            x, y = np.flatnonzero(ids[:n_a] == i), n_a + np.flatnonzero(ids[n_a:] == i)
            for u, v in tile_links(a[x], a[y], threshold, False):
                np.subtract.at(out, x[u], 1)
                np.subtract.at(out, y[v], 1)
    return out, root


def _sides(batches, names):
    """(key, {side: (ids, vectors)}) for each run of equal keys in sorted batches.

    names: the key columns, then side, id and vector."""
    *keys, side, id_, vec = names
    key, parts = None, {}

    def done():
        return key, {k: (np.concatenate([x for x, _ in v]), np.concatenate([x for _, x in v])) for k, v in parts.items()}

    for batch in batches:
        if not len(batch):
            continue
        table = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, side)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in table], axis=0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(batch)], strict=True):
            now = tuple(c[a] for c in table)
            if now[:-1] != key:
                if parts:
                    yield done()
                key, parts = now[:-1], {}
            ids = batch.column(id_).slice(a, b - a).to_numpy(zero_copy_only=False)
            parts.setdefault(now[-1], []).append((ids, matrix(batch.column(vec).slice(a, b - a))))
    if parts:
        yield done()


def _near(threshold: float):
    def run(batches):
        for (_, _, i, j), parts in _sides(batches, ("label", "dim", "i", "j", "side", "id", "vec")):
            if len(parts) < (1 if i == j else 2):
                continue
            ids, vec = (np.concatenate([parts[k][x] for k in sorted(parts)]) for x in (0, 1))
            links, root = tile_groups(ids, vec, len(parts[0][0]), threshold)
            at = np.flatnonzero(links)
            out = np.flatnonzero(ids != ids[root])
            # One row for each vector (its links in this tile) and for each member of a group.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[at], ids[out]])),
                    pa.array(np.concatenate([np.zeros(len(at), np.int64), ids[root[out]]]), mask=np.arange(len(at) + len(out)) < len(at)),
                    pa.array(np.concatenate([links[at], np.zeros(len(out), np.int64)])),
                ],
                ["u", "v", "n"],
            )

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Near-duplicate vectors: (vec_id, n_links, component_id, kept), a row for each row of `vectors`.

    Vectors are compared when their labels are equal and not null and their lengths
    are equal. A vector that is null, empty, zero or holds a null or non-finite
    component links with nothing, as does a row with a null id (component null, kept).
    Components of any finite size count: rows are scaled by powers of two before they are
    multiplied. Rows that repeat an id count as one vector that has the links of each row,
    to rows of other ids. Further columns, whatever their names, are ignored; an empty
    table gives no rows.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    good = base.where("id is not null and label is not null").where(_usable("vec")).where(F.expr("exists(vec, x -> x <> 0)"))
    good = good.withColumn("dim", F.size("vec"))
    sizes = good.groupBy("label", "dim").agg(_blocks(F.count("*"), F.col("dim"), TILE).alias("nb"))
    # The row number in the hash spreads the rows of a repeated id.
    cut = good.withColumn("b", F.xxhash64("id", F.monotonically_increasing_id())).join(sizes, ["label", "dim"]).withColumn("b", F.pmod("b", "nb").cast("int"))
    mates = F.explode(F.expr("transform(sequence(0, nb - 1), o -> struct(least(b, o) as i, greatest(b, o) as j, if(b <= o, 0, 1) as side))"))
    tiles = cut.select("label", "dim", mates.alias("t"), "id", "vec").select("label", "dim", "t.i", "t.j", "t.side", "id", "vec")
    tiles = tiles.repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j", "side")
    found = materialize(tiles.mapInArrow(_near(threshold), "u long, v long, n long"), "near")
    count = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("v is not null").select("u", "v"))
    out = base.select("id").join(count, F.col("id") == F.col("u"), "left").join(groups, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def top_block(ids: np.ndarray, qid: int, q: np.ndarray, k: int, columns: np.ndarray, mass: np.ndarray, block: int, entered: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a candidate block for one query, ties to the smaller id.

    columns: the candidates by dimension (vertical layout); mass: their squared norms.
    Dimensions are taken in the order of the query's mass, `block` at a time. A candidate
    leaves once its sum plus the largest inner product that the remaining masses allow is
    below the k-th best of the full scores of those that lead after the first block.
    entered: gets the number of candidates that enter each block.
    """
    dims = len(q)
    order = np.argsort(-np.abs(q), kind="stable")
    left = np.concatenate([np.cumsum((q[order] ** 2)[::-1])[::-1], [0.0]])
    live = np.flatnonzero(ids != qid)
    score, rest, floor = np.zeros(len(live)), mass[live], -np.inf
    for lo in range(0, dims, block):
        if entered is not None:
            entered.append(len(live))
        at = order[lo : lo + block]
        part = columns[at] if len(live) == columns.shape[1] else columns[np.ix_(at, live)]
        score = score + q[at] @ part
        if lo + block >= dims:
            break
        rest = rest - np.einsum("ij,ij->j", part, part)
        if not lo and len(live) > 8 * k:
            lead = live[np.argpartition(score, len(live) - 8 * k)[-8 * k :]]
            floor = np.partition(q @ columns[:, lead], 7 * k)[7 * k]
        spread = np.sqrt(left[lo + block] * (np.maximum(rest, 0.0) + 1e-12 * mass[live])) * (1 + 1e-9) + SLACK
        keep = score + spread >= floor
        if not keep.all():
            live, score, rest = live[keep], score[keep], rest[keep]
    best = np.lexsort((ids[live], -score))[:k]
    return ids[live[best]], score[best]


def _whole(x: float) -> int:
    """floor(256 x) of any finite x."""
    return 256 * int(x) if abs(x) >= 2.0**53 else int(np.floor(256.0 * x))


def _search(k: int, block: int):
    def run(batches):
        for _, parts in _sides(batches, ("dim", "i", "j", "side", "id", "vec")):
            if len(parts) < 2:
                continue
            (qids, q), (ids, vec) = parts[0], parts[1]
            largest = max(float(np.abs(q).max(initial=0)), float(np.abs(vec).max(initial=0)))
            out_q, out_id, out_s = [], [], []
            if largest < 2**18 / q.shape[1] ** 0.5:  # every sum of products is below 2^53
                q, columns = np.floor(256.0 * q), np.ascontiguousarray(np.floor(256.0 * vec).T)
                mass = np.einsum("ij,ij->j", columns, columns)
                for qid, x in zip(qids.tolist(), q, strict=True):
                    got, s = top_block(ids, qid, x, k, columns, mass, block)
                    out_q += [qid] * len(got)
                    out_id += got.tolist()
                    out_s += s.astype(np.int64).tolist()
            else:  # components so large that doubles would round the sums: whole numbers of any length
                whole = [[_whole(v) for v in row] for row in vec.tolist()]
                for qid, x in zip(qids.tolist(), q, strict=True):
                    x = [_whole(v) for v in x.tolist()]
                    scored = sorted((-sum(a * b for a, b in zip(x, row, strict=True)), i) for row, i in zip(whole, ids.tolist(), strict=True) if i != qid)[:k]
                    out_q += [qid] * len(scored)
                    out_id += [i for _, i in scored]
                    out_s += [max(-(2**63), min(2**63 - 1, -s)) for s, _ in scored]
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_s, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 8) -> DataFrame:
    """The k highest integer inner products of each query: (query_id, rank, vec_id, score).

    Components count as floor(256 * x). Queries are the rows whose id is divisible by
    `every`, candidates all rows but the query's own id and of the query's length; ties
    go to the smaller id. Vectors that are null, empty or hold null or non-finite
    components, and rows with a null id, take no part. Rows that repeat an id are
    candidates each; a repeated query id asks once, with its smallest vector. Whole numbers
    of any length are computed exactly; scores beyond 64 bits are given as the nearest long,
    which counts in the order too. Further columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null").where(_usable("vec")).withColumn("dim", F.size("vec"))
    asks = base.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("vec").alias("vec"))
    sizes = base.groupBy("dim").agg(_blocks(F.count("*"), F.col("dim"), CANDIDATES).alias("nc")).join(asks.groupBy("dim").agg(_blocks(F.count("*"), F.col("dim"), QUERIES).alias("nq")), "dim")
    sizes = materialize(sizes, "sizes")

    def dealt(rows: DataFrame, side: int, own: str, other: str, i: str, j: str) -> DataFrame:
        rows = rows.withColumn("b", F.xxhash64("id", F.monotonically_increasing_id())).join(sizes, "dim").withColumn("b", F.pmod("b", own).cast("int"))
        return rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("dim", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "id", "vec")

    tiles = dealt(asks, 0, "nq", "nc", "b", "o").union(dealt(base, 1, "nc", "nq", "o", "b"))
    tiles = tiles.repartition("dim", "i", "j").sortWithinPartitions("dim", "i", "j", "side")
    best = tiles.mapInArrow(_search(k, block), "query_id long, vec_id long, score long")
    # A tile gives at most k rows for a query; the rank's limit is taken below the shuffle too.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
