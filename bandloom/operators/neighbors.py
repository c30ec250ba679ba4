"""Exact nearest neighbours and the vote over them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bandloom.functions.matrix import matrix
from bandloom.functions.ordering import seeded_hash
from bandloom.functions.sizing import SALTS, bounded_rows
from bandloom.operators.prepare import band_count
from bandloom.session import cut_lineage

# Doubles the reference side may hold to be copied to every task.
BROADCAST_DOUBLES = 8_000_000
# Rows of one block pair of the partitioned join: queries, and references, of which
# fewer fit with many bands. A larger block is searched faster per pair of rows.
BLOCK_ROWS = 20_000
REF_BLOCKS, REF_DOUBLES = 3, 4_000_000
# Pairs of blocks below which blocks of queries are made smaller, down to an eighth.
FEW_PAIRS = 64
PIVOTS = 256
# Rows of a leaf, and leaves and queries measured against each other at once: 8 MB.
LEAF_ROWS = 512
TILE_LEAVES = 8
QUERY_ROWS = 256
# With few bands small blocks of queries meet few leaves; with more, the first leaf says little.
FEW_BANDS, FEW_QUERY_ROWS = 8, 32
FIRST_LEAVES = 4
# Doubles of queries that are ordered together.
GATHERED_DOUBLES = 200_000
# Rows of one batch of queries that are sent to blocks.
SENT_ROWS = 16_384


def neighbor_type(refs: DataFrame) -> str:
    return f"array<struct<distance:double,ref_id:{refs.schema['sample_id'].dataType.simpleString()},label:int>>"


def plain_ids(ids: np.ndarray) -> np.ndarray:
    """Ids in a form that numpy can sort."""
    return ids.astype(str) if ids.dtype == object else ids


def leaf_order(x: np.ndarray, size: int) -> np.ndarray:
    """Places of the rows, halved along the widest band until stretches of `size` rows lie close together."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        at = open_.pop()
        if len(at) <= size:
            done.append(at)
            continue
        rows = x[at]
        band = (rows.max(axis=0) - rows.min(axis=0)).argmax()
        # Whole leaves on the left side, so that only the last leaf is short.
        half = max(1, round(len(at) / size / 2)) * size
        cut = np.argpartition(rows[:, band], half - 1)
        open_ += [at[cut[half:]], at[cut[:half]]]
    return np.concatenate(done) if done else np.empty(0, int)


@dataclass
class Leaves:
    """References in leaf order, with their places in the table and the bounds of every leaf.

    The squared length of a row stands behind its bands, so that one product gives distances.
    """

    x: np.ndarray
    places: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, r: np.ndarray) -> Leaves:
        # Rows that are not finite have no distance and are nobody's neighbour.
        finite = np.flatnonzero(np.isfinite(r).all(axis=1))
        places = finite[leaf_order(r if len(finite) == len(r) else r[finite], LEAF_ROWS)]
        d = r.shape[1]
        x = np.empty((len(places), d + 1))
        np.take(r, places, axis=0, out=x[:, :d], mode="clip")
        np.einsum("ij,ij->i", x[:, :d], x[:, :d], out=x[:, d])
        starts = np.arange(0, len(x), LEAF_ROWS)
        low, high = (f.reduceat(x[:, :d], starts, axis=0) if len(x) else x[:, :d] for f in (np.minimum, np.maximum))
        return cls(x, places, low, high)


def closest(q: np.ndarray, r: np.ndarray | Leaves, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the k rows with the smallest (distance, id), distances exact.

    Blocks of close queries meet the leaves of the references from near to far, a
    tile of them at a time, until the next leaf lies beyond every k-th distance. A
    matrix product gives approximate distances; every row within its rounding error
    of the k-th is then measured exactly.
    """
    leaves = r if isinstance(r, Leaves) else Leaves.of(r)
    out = [(np.empty(0, int), np.empty(0))] * len(q)
    if not len(leaves.x):
        return out
    finite = np.flatnonzero(np.isfinite(q).all(axis=1))
    d = q.shape[1]
    scale = leaves.x[:, d].max()
    size, first = (FEW_QUERY_ROWS, 1) if d <= FEW_BANDS else (QUERY_ROWS, FIRST_LEAVES)
    order = finite[leaf_order(q[finite], size)]
    for start in range(0, len(order), size):
        at = order[start : start + size]
        block = q[at]
        own = (block * block).sum(axis=1)
        slack = 1e-9 * (own + scale) + 1e-300
        # The product leaves out the squared length of the query, which every reference shares.
        turned = np.concatenate((-2.0 * block, np.ones((len(block), 1))), axis=1)
        kept = [(np.empty(0, int), np.empty(0))] * len(block)
        worst = np.full(len(block), np.inf)
        gap = np.maximum(np.maximum(leaves.low - block.max(axis=0), block.min(axis=0) - leaves.high), 0.0)
        gap = (gap * gap).sum(axis=1)
        visit = np.argsort(gap, kind="stable")
        done, tile = 0, first
        while done < len(visit) and gap[visit[done]] <= worst.max() * (1 + 1e-9):
            rows = (visit[done : done + tile, None] * LEAF_ROWS + np.arange(LEAF_ROWS)).ravel()
            rows = rows[rows < len(leaves.x)]
            done, tile = done + tile, min(2 * tile, TILE_LEAVES)
            x = leaves.x[rows]
            rough = turned @ x.T
            limit = np.where(np.isfinite(own), worst - own, np.inf)
            if not np.isfinite(worst).all():
                last = min(k, len(rows)) - 1
                limit = np.minimum(limit, np.partition(rough, last, axis=1)[:, last] if last == k - 1 else np.inf)
            near = rough <= (limit + slack)[:, None]
            for i in np.flatnonzero(near.any(axis=1)):
                met = np.flatnonzero(near[i])
                places = np.concatenate((kept[i][0], leaves.places[rows[met]]))
                exact = np.concatenate((kept[i][1], ((x[met, :d] - block[i]) ** 2).sum(axis=1)))
                best = np.lexsort((ids[places], exact))[:k]
                kept[i] = places[best], exact[best]
                if len(best) == k:
                    worst[i] = exact[best[-1]]
        for i, (places, exact) in zip(at, kept):
            out[i] = places, np.sqrt(exact)
    return out


def knn_join(queries: DataFrame, refs: DataFrame, k: int, d: int | None = None, keep: Sequence[str] = ("sample_id",),
             limit: int = BROADCAST_DOUBLES) -> DataFrame:
    """Columns in `keep` and `neighbors`: the k nearest references, nearest first.

    `refs` has sample_id, label and bands. A reference side of checked size is
    copied to the tasks; a larger one is joined block by block, still exactly.
    """
    d = d or band_count(refs)
    cap = max(1, limit // (d + 2))
    table = refs.select("sample_id", F.col("label").cast("int").alias("label"), "bands")
    if table.select(F.lit(1)).limit(cap + 1).count() <= cap:
        return _copied_join(queries, table.toArrow(), neighbor_type(refs), k, d, list(keep))
    return _blocked_join(queries, table, k, d, list(keep))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have `rows` rows, so that close queries are found together."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _copied_join(queries: DataFrame, refs: pa.Table, kind_out: str, k: int, d: int, keep: list[str]) -> DataFrame:
    batch = refs.combine_chunks().to_batches()
    r = matrix(batch[0], d) if batch else np.empty((0, d))
    ids = plain_ids(refs.column("sample_id").to_numpy()) if batch else np.empty(0, int)
    labels = refs.column("label").to_numpy() if batch else np.empty(0, int)
    shared = queries.sparkSession.sparkContext.broadcast((Leaves.of(r), ids, labels))
    schema = T.StructType([queries.schema[c] for c in keep] + [T.StructField("neighbors", T.DataType.fromDDL(kind_out))])

    def run(batches):
        rr, rid, rlab = shared.value
        for b in _gathered(batches, max(1, GATHERED_DOUBLES // d)):
            found = closest(matrix(b, d), rr, rid, k)
            at = np.concatenate([a for a, _ in found])
            ends = np.concatenate([[0], np.cumsum([len(a) for a, _ in found])]).astype(np.int32)
            structs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([x for _, x in found])), pa.array(rid[at]), pa.array(rlab[at].astype(np.int32))],
                names=["distance", "ref_id", "label"],
            )
            lists = pa.ListArray.from_arrays(pa.array(ends), structs)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists], names=[*keep, "neighbors"])

    return queries.select(*keep, "bands").mapInArrow(run, schema)


def _top_copies(refs: DataFrame, k: int) -> DataFrame:
    """At most the k smallest ids of every distinct vector; more can never be
    among k neighbours. Two steps, so copies of one vector are first thinned
    out in several tasks."""
    spread = refs.withColumn("_salt", F.pmod(F.xxhash64("sample_id"), F.lit(64)))
    first = Window.partitionBy("bands", "_salt").orderBy("sample_id")
    second = Window.partitionBy("bands").orderBy("sample_id")
    thin = spread.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k)
    return thin.withColumn("_rn", F.row_number().over(second)).filter(F.col("_rn") <= k).drop("_rn", "_salt")


def _blocked_join(queries: DataFrame, refs: DataFrame, k: int, d: int, keep: list[str]) -> DataFrame:
    """References are cut into cells around pivots, cells that lie close together make a
    part, and a cell too large for one is cut into blocks.

    The k smallest pivot distances of every cell bound the k-th neighbour of a
    query from above; parts whose cells all lie beyond the bound are skipped. Queries and
    references of a part meet in blocks of bounded size on both sides.
    """
    # Counted, drawn from and placed below, so written once to the shared folder.
    refs = cut_lineage(_top_copies(refs, k), "thinned")
    pivot_count = max(8, min(PIVOTS, 4 * math.ceil(refs.count() / BLOCK_ROWS)))
    seeds = refs.select("bands", seeded_hash("pivot", "sample_id").alias("_h")).orderBy("_h").limit(pivot_count).collect()
    pivots = np.array([r["bands"] for r in seeds])

    def place(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = matrix(b, d)
            gap = _gaps(x, pivots)
            cell = gap.argmin(axis=1)
            away = gap[np.arange(len(x)), cell]
            arrays = [b.column(c) for c in ("sample_id", "label", "bands")] + [pa.array(cell.astype(np.int32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(arrays, names=["sample_id", "label", "bands", "cell", "away"])

    kind = refs.schema["sample_id"].dataType.simpleString()
    # Read several times below, so written once to the shared folder.
    placed = cut_lineage(
        refs.mapInArrow(place, f"sample_id {kind}, label int, bands array<double>, cell int, away double"), "refs")
    stats = bounded_rows(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")), PIVOTS)
    # The k smallest pivot distances per cell; the row_number filter is applied before the shuffle.
    closest_first = Window.partitionBy("cell").orderBy("away", "sample_id")
    inner = placed.select("cell", "away", "sample_id").withColumn("_rn", F.row_number().over(closest_first)).filter(F.col("_rn") <= k)
    inner_rows = bounded_rows(inner.select("cell", "away"), PIVOTS * k)
    stats = [stats[i] for i in leaf_order(pivots[[r["cell"] for r in stats]], 1)]
    starts, blocks = _parts([r["n"] for r in stats], min(REF_BLOCKS * BLOCK_ROWS, max(1, REF_DOUBLES // d)))
    part_of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(stats)]))
    cells = np.array([r["cell"] for r in stats])
    radius = np.array([r["radius"] for r in stats])
    near = np.full((len(cells), k), np.inf)
    fill = {c: 0 for c in cells}
    at = {c: i for i, c in enumerate(cells)}
    for r in sorted(inner_rows, key=lambda r: r["away"]):
        near[at[r["cell"]], fill[r["cell"]]] = r["away"]
        fill[r["cell"]] += 1
    centers = pivots[cells]

    # Copies of one query vector are looked up once, under a name made of the vector.
    asked = queries.select(*keep, "bands", F.md5(F.col("bands").cast("string")).alias("_qid"))
    distinct = asked.groupBy(F.col("_qid").alias("qid")).agg(F.first("bands").alias("bands"))

    def spread(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            gaps = _gaps(matrix(b, d), centers)
            # A query may go to every block, so few queries are spread at a time.
            for start in range(0, len(gaps), QUERY_ROWS):
                gap = gaps[start : start + QUERY_ROWS]
                bound = np.empty(len(gap))
                for i in range(len(gap)):
                    sums = (gap[i][:, None] + near).ravel()
                    bound[i] = np.partition(sums, k - 1)[k - 1] if sums.size >= k else np.inf
                reach = gap - radius[None, :] <= bound[:, None] * (1 + 1e-9) + 1e-9
                row, col = np.nonzero(np.logical_or.reduceat(reach, starts, axis=1))
                times = blocks[col]
                row, col = np.repeat(row + start, times), np.repeat(col, times)
                block = np.concatenate([np.arange(t) for t in times]) if len(times) else np.empty(0, int)
                for cut in range(0, len(row), SENT_ROWS):
                    rows = slice(cut, cut + SENT_ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("qid").take(pa.array(row[rows])), b.column("bands").take(pa.array(row[rows])),
                         pa.array(col[rows].astype(np.int32)), pa.array(block[rows].astype(np.int32))],
                        names=["qid", "bands", "part", "block"])

    sent = cut_lineage(
        distinct.select("qid", "bands").mapInArrow(spread, "qid string, bands array<double>, part int, block int"), "queries")
    visits = {r["part"]: r["n"] for r in bounded_rows(
        sent.filter("block = 0").groupBy("part").agg(F.count(F.lit(1)).alias("n")), PIVOTS)}
    # Parts by cell, and blocks and shares by part, as literals.
    parts_of = F.create_map(*[F.lit(int(v)) for pair in zip(cells, part_of) for v in pair])
    blocks_of = F.array(*[F.lit(int(m)) for m in blocks])
    shares_of = F.array(*[F.lit(n) for n in _shares(blocks, [visits.get(p, 0) for p in range(len(blocks))])])
    left = sent.withColumn("share", F.pmod(F.xxhash64("qid"), shares_of[F.col("part")]).cast("int"))
    # References of parts that no query reaches are not sent.
    right = placed.withColumn("part", parts_of[F.col("cell")]).filter(F.col("part").isin(sorted(visits))).withColumn(
        "block", F.pmod(F.xxhash64("sample_id"), blocks_of[F.col("part")]).cast("int")).withColumn(
        "share", F.explode(F.sequence(F.lit(0), shares_of[F.col("part")] - 1))
    ).select("sample_id", "label", "bands", "part", "block", "share")

    ref_kind = to_arrow_type(refs.schema["sample_id"].dataType)

    def pair(qs: pa.Table, rs: pa.Table) -> pa.Table:
        names, counts, at = ["qid", "distance", "ref_id", "label"], [], np.empty(0, int)
        away, ids, labels = np.empty(0), np.empty(0, int), np.empty(0, int)
        if len(qs) and len(rs):
            ids, labels = plain_ids(rs.column("sample_id").to_numpy()), rs.column("label").to_numpy()
            found = closest(*(matrix(t.combine_chunks().to_batches()[0], d) for t in (qs, rs)), ids, k)
            counts, at, away = [len(a) for a, _ in found], *(np.concatenate(c) for c in zip(*found))
        qids = pa.array(np.repeat(qs.column("qid").to_numpy(), counts) if len(at) else [], pa.string())
        return pa.Table.from_arrays([qids, pa.array(away), pa.array(ids[at]).cast(ref_kind), pa.array(labels[at]).cast(pa.int32())], names=names)

    keys = ["part", "block", "share"]
    merged = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        pair, f"qid string, distance double, ref_id {kind}, label int")
    best = Window.partitionBy("qid").orderBy("distance", "ref_id")
    top = merged.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= k)
    lists = top.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("distance", "ref_id", "label"))).alias("neighbors"))
    # Every copy of a query vector takes the list that was looked up for it; copies
    # of one vector may be many, so they are spread by a salt.
    salt = F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int") if keep else F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    copies = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = asked.drop("bands").withColumn("_salt", salt).join(
        copies.withColumnRenamed("qid", "_qid"), ["_qid", "_salt"])
    return joined.select(*keep, "neighbors")


def _parts(sizes: Sequence[int], most: int) -> tuple[list[int], np.ndarray]:
    """Where the parts of neighbouring cells begin, and the blocks of each: parts have at most `most`
    rows, but a larger cell is one of its own, in several blocks."""
    starts, held = [], []
    for i, n in enumerate(sizes):
        if not starts or held[-1] + n > most:
            starts.append(i)
            held.append(0)
        held[-1] += n
    return starts, np.array([math.ceil(n / most) for n in held])


def _shares(blocks: Sequence[int], visits: Sequence[int]) -> list[int]:
    """Blocks of queries of every part, as large as leave enough pairs of blocks to be spread."""
    for size in (max(1, BLOCK_ROWS >> i) for i in range(4)):
        shares = [math.ceil(n / size) or 1 for n in visits]
        if sum(int(b) * n for b, n in zip(blocks, shares)) >= FEW_PAIRS:
            break
    return shares


def _gaps(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, measured pivot by pivot."""
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in p], axis=1)


def vote(neighbors: Column, weights: str = "uniform") -> Column:
    """The class with the most (or closest) neighbours; the smallest code wins ties."""
    codes = F.array_distinct(F.transform(neighbors, lambda e: e["label"]))

    def share(code: Column) -> Column:
        mine = F.filter(neighbors, lambda e: e["label"] == code)
        if weights == "uniform":
            return F.size(mine).cast("double")
        return F.aggregate(mine, F.lit(0.0), lambda a, e: a + F.when(e["distance"] == 0, F.lit(1e300)).otherwise(1.0 / e["distance"]))

    ranked = F.transform(codes, lambda c: F.struct(share(c).alias("share"), (-c).alias("neg")))
    return -F.array_max(ranked)["neg"]


def vote_share(neighbors: Column, code: Column) -> Column:
    """Share of neighbours of a class: its probability."""
    return F.size(F.filter(neighbors, lambda e: e["label"] == code)) / F.size(neighbors)


def knn_predict(queries: DataFrame, refs: DataFrame, k: int, d: int | None = None, keep: Sequence[str] = ("sample_id",),
                weights: str = "uniform", classes: Sequence[int] | None = None) -> DataFrame:
    """Class and confidence by vote; probabilities when `classes` are given."""
    found = knn_join(queries, refs, k, d, keep).withColumn("class", vote(F.col("neighbors"), weights))
    out = [*keep, "class", vote_share(F.col("neighbors"), F.col("class")).alias("confidence")]
    if classes:
        out.append(F.array(*[vote_share(F.col("neighbors"), F.lit(int(c))) for c in classes]).alias("probability"))
    return found.select(*out)
