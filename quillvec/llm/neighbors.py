"""Problem 1: the most similar vectors of every vector, by an inverted multi-index.

The two halves of a vector are quantised separately, so that two small codebooks
make a fine grid of cells. A query visits cells in the order of the summed
distances of its halves to the two centroids, which a heap yields pair by pair,
and the vectors of the visited cells are compared exactly. How many cells that
takes is measured: the true neighbours of a bounded sample of queries say in which
of their cells they lie.

Cells that lie close together make a block of bounded size, so that a vector
travels to few tasks; a larger cell is split. The queries of a block are split
too, by their number as the sample foretells it: who asks is bounded like what is
held.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.plans.lineage import cut

from .vectors import kmeans, matrix, sample_matrix, squared_distances, unit_vectors

#: Vectors in the sample on which the codebooks are fitted; every vector is indexed.
SAMPLE_ROWS = 20_000
#: Occupied cells that a query visits at least; queries whose true neighbours say how many more it takes, and the factor put on that.
PROBES = 32
CALIBRATION_QUERIES, LIMIT_QUERIES, MARGIN = 400, 2_000, 1.1
#: Vectors that a block holds, queries that are answered together in one part of it (both foretold), and rows of one task.
BLOCK_ROWS = 32_000
ASK_ROWS = 64_000
TASK_ROWS = 48_000
#: Vectors for which there is a coarse center.
REGION_ROWS = 16_000
#: Centroids of a half, and coarse centers that put cells in order.
MAX_CENTROIDS = 1_024
MAX_COARSE = 2_000
#: Digits to which similarities are compared, so that equal ones are ties wherever they are computed.
DIGITS = 6


def visit_order(a: np.ndarray, b: np.ndarray, first: np.ndarray, second: np.ndarray, size: np.ndarray, probes: int) -> list[int]:
    """Cells in ascending order of `a[i] + b[j]` (both ascending, for centroids `first[i]`, `second[j]`) until `probes` occupied ones are found."""
    n, width = len(a), len(b)
    heap, out = [(a[0] + b[0], 0, 0)], []
    pop, push = heapq.heappop, heapq.heappush
    while heap and len(out) < probes:
        _, i, j = pop(heap)
        cell = first[i] * width + second[j]
        if size[cell]:
            out.append(cell)
        if j + 1 < width:
            push(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < n:
            push(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


class MultiIndex:
    """Codebooks of the two halves, the number of vectors in each cell, and the blocks of each cell."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 11):
        self.half = sample.shape[1] // 2
        k = int(np.clip(round(1.1 * n ** (1 / 3)), 1, min(MAX_CENTROIDS, max(1, len(sample)))))
        self.books = [kmeans(sample[:, : self.half], k, 8, seed), kmeans(sample[:, self.half :], k, 8, seed + 1)]
        self.width = len(self.books[1])
        # cells go to the nearest of some coarse centers, so that those a query visits lie in few blocks
        coarse = kmeans(sample, int(np.clip(round(n / REGION_ROWS), 1, MAX_COARSE)), 8, seed)
        middle = np.hstack([np.repeat(self.books[0], self.width, 0), np.tile(self.books[1], (len(self.books[0]), 1))])
        self.region = np.concatenate([squared_distances(middle[i : i + 20_000], coarse).argmin(1) for i in range(0, len(middle), 20_000)])
        self.size = np.zeros(len(self.region), np.int64)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared_distances(x[:, : self.half], self.books[0]), squared_distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.width + b.argmin(1)

    def fill(self, cell: np.ndarray, count: np.ndarray) -> None:
        """Take in how many vectors each cell has, and cut the cells, in the order of their regions, into blocks."""
        self.size[cell] = count
        self.size_list = self.size.tolist()
        order = np.argsort(self.region, kind="stable")
        order = order[self.size[order] > 0]
        self.block, self.pieces = np.full(len(self.size), -1), np.ones(len(self.size), np.int64)
        block, held, region = -1, BLOCK_ROWS, -1
        for c in order.tolist():
            n, r = int(self.size[c]), int(self.region[c])
            if n > BLOCK_ROWS:  # a cell that is blocks by itself
                self.block[c], self.pieces[c] = block + 1, -(-n // BLOCK_ROWS)
                block, held = block + int(self.pieces[c]), BLOCK_ROWS
                continue
            if held + n > BLOCK_ROWS or (r != region and held > BLOCK_ROWS // 2):
                block, held = block + 1, 0
            self.block[c], held, region = block, held + n, r
        self.blocks, self.block_list, self.piece_list = block + 1, self.block.tolist(), self.pieces.tolist()
        self.held = np.bincount(self.block[order], weights=self.size[order] / self.pieces[order], minlength=self.blocks)
        for c in np.flatnonzero(self.pieces > 1):
            self.held[self.block[c] : self.block[c] + self.pieces[c]] = self.size[c] / self.pieces[c]

    def visits(self, x: np.ndarray, probes: int) -> list[list[int]]:
        size, out = self.size_list, []
        for a, b in zip(*self.distances(x), strict=True):
            i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            out.append(visit_order(a[i].tolist(), b[j].tolist(), i.tolist(), j.tolist(), size, probes))
        return out

    def blocks_of(self, cells: list[int]) -> dict[int, list[int]]:
        """The blocks of some cells, and the cells in each."""
        out: dict[int, list[int]] = {}
        for c in cells:
            first = self.block_list[c]
            for block in range(first, first + self.piece_list[c]):
                out.setdefault(block, []).append(c)
        return out

    def ranks(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many occupied cells a query visits up to one of its cells."""
        occupied = self.size > 0
        out = np.zeros(len(x), np.int64)
        a, b = self.distances(x)
        for q in range(len(x)):
            apart = (a[q][:, None] + b[q][None, :]).ravel()
            out[q] = np.count_nonzero(occupied & (apart <= apart[cell[q]] + 1e-12))
        return out

    def share_out(self, asked: np.ndarray) -> None:
        """Parts of each block by the queries it will be asked, and the task of each part, the heaviest first to the lightest task."""
        self.parts = np.maximum(1, np.ceil(asked / ASK_ROWS)).astype(np.int64)
        self.first_part = np.cumsum(self.parts) - self.parts
        load = np.repeat(self.held + asked / self.parts, self.parts)
        self.tasks = int(np.clip(np.ceil(load.sum() / TASK_ROWS), 1, max(1, len(load))))
        self.task = np.zeros(len(load), np.int64)
        heap = [(0.0, t) for t in range(self.tasks)]
        for p in np.argsort(-load, kind="stable").tolist():
            weight, t = heapq.heappop(heap)
            self.task[p] = t
            heapq.heappush(heap, (weight + load[p], t))


def _top(query: np.ndarray, other: np.ndarray, similarity: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the `k` most similar of each query, ties by the other's number."""
    order = np.lexsort((other, -similarity, query))
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]


def _nearest(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `k` greatest of each row, with all that tie with the last."""
    if sim.shape[1] > k:
        return np.nonzero(sim >= np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k][:, None])
    return tuple(g.ravel() for g in np.indices(sim.shape))


def _compare(x, cells_of, entries, entry_cell, k, least):
    """Each query against the vectors of its cells: query number, entry number, similarity."""
    lengths = np.array([len(c) for c in cells_of])
    query = np.repeat(np.arange(len(cells_of)), lengths)
    cell = np.fromiter((c for cs in cells_of for c in cs), np.int64, int(lengths.sum()))
    order = np.argsort(cell, kind="stable")
    query, cell = query[order], cell[order]
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
    found: list[tuple] = []
    for s, e in zip(start, np.r_[start[1:], len(cell)], strict=False):
        lo, hi = np.searchsorted(entry_cell, [cell[s], cell[s] + 1])
        if lo == hi:
            continue
        step = max(1, 2_000_000 // (hi - lo))
        for a in range(s, e, step):
            q = query[a : min(e, a + step)]
            sim = x[q] @ entries[lo:hi].T
            if least is not None:
                i, j = np.nonzero(sim >= least)
                found.append((q[i], j + lo, np.round(sim[i, j].astype(np.float64), DIGITS)))
            else:
                sim = np.round(sim, DIGITS)
                i, j = _nearest(sim, k + 1)  # the query itself may be one
                found.append((q[i], j + lo, np.round(sim[i, j].astype(np.float64), DIGITS)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _probes_for(index: MultiIndex, nodes: DataFrame, asked: DataFrame, k: int, dim: int, least: float | None, recall: float) -> int:
    """The occupied cells in which a sample of the queries has this share of its true neighbours, which a scan of all vectors finds."""
    wanted = CALIBRATION_QUERIES if least is None else LIMIT_QUERIES
    many = asked.count()
    sample = asked if many <= wanted else asked.sample(fraction=wanted / many, seed=23)
    rows = sample.select("node", "v").limit(2 * wanted).toArrow()
    own = rows.column("node").to_numpy()
    x = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float32).reshape(-1, dim)
    if not len(x):
        return PROBES
    shared = nodes.sparkSession.sparkContext.broadcast((x, own, index))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, mine, ix = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 4_000):
                batch = whole.slice(s, 4_000)
                y = matrix(batch.column(1), dim)
                sim = q @ y.T
                sim[mine[:, None] == batch.column(0).to_numpy()[None, :]] = -2
                if least is not None:
                    i, j = np.nonzero(sim >= least)
                else:
                    i, j = _nearest(sim, k)
                top = _top(i, j, sim[i, j], k)
                i, j = i[top], j[top]
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(ix.cells(y)[j] if len(j) else j, pa.int64()), pa.array(sim[i, j].astype(np.float64))], names=["q", "cell", "similarity"])

    best = Window.partitionBy("q").orderBy(F.desc("similarity"), "cell")
    found = nodes.select("node", "v").mapInArrow(scan, "q int, cell bigint, similarity double").withColumn("r", F.row_number().over(best)).where((F.col("r") <= k) & (F.col("similarity") > -1.5)).toPandas()
    shared.unpersist()
    if not len(found):
        return PROBES
    ranks = np.sort(index.ranks(x[found["q"].to_numpy(np.int64)], found["cell"].to_numpy(np.int64)))
    return max(PROBES, int(np.ceil(MARGIN * ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))])))


def similar_vectors(
    df: DataFrame, id_col: str = "doc_id", vector_col: str = "doc_vectors", k: int = 10, dim: int = 64,
    min_similarity: float | None = None, probes: int | float | None = None, queries: DataFrame | None = None, recall: float = 0.95,
) -> DataFrame:
    """`id, other, rank INT, similarity DOUBLE`: the `k` vectors of greatest cosine similarity of every usable vector.

    Usable is a vector of `dim` components, none null, NaN or infinite, not all
    zero; its length doesn't matter. Other vectors have no rows and are no one's
    neighbour. Each id counts once (repeated rows are taken to be equal) and is
    not its own neighbour. Similarities are rounded to six digits, and ties go by
    the smaller id. `min_similarity` leaves out less similar ones. `queries`
    (with the same id column) limits whose neighbours are sought; all rows stay
    in the index. Copies of one vector are indexed once, and their ids are put
    back in the end. `dim` must be even.

    The answer is approximate: neighbours outside the cells visited are missed.
    `probes` is the number of occupied cells that a query visits, or below 1 the
    share of them; without it so many are visited that a sample of the queries
    finds the share `recall` of its true neighbours.
    An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    units = unit_vectors(df, id_col, vector_col, dim)
    id_type = units.schema["id"].dataType.simpleString()
    members = cut(units.select("id", "node").distinct(), "members")
    n = members.select("node").distinct().count()
    if not n:
        return members.select("id", F.col("id").alias("other"), F.lit(0).alias("rank"), F.lit(0.0).alias("similarity")).where("false")
    index = MultiIndex(sample_matrix(units, n, SAMPLE_ROWS, dim, 5), n)
    shared = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.size), np.int64)
        for batch in batches:
            total += np.bincount(shared.value.cells(matrix(batch.column(0), dim)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    sizes = units.select("v").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    index.fill(sizes["cell"].to_numpy(np.int64), sizes["n"].to_numpy(np.int64))
    shared.unpersist()
    everyone = queries is None
    asked = None if everyone else members.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    rows = units.withColumn("asks", F.lit(True))
    if not everyone:
        asking = asked.select("node").distinct().withColumn("asks", F.lit(True))
        rows = units.join(asking, "node", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    who = rows.where("asks").select("node", "v")
    if probes is None:
        probes = _probes_for(index, units, who, k, dim, min_similarity, recall)
    elif probes < 1:
        probes = max(PROBES, int(np.ceil(probes * np.count_nonzero(index.size))))
    # how many queries each block will be asked, foretold by a sample; it decides where work is done, not what is found
    askers = n if everyone else who.count()
    foretold = sample_matrix(who, max(1, askers), 1_000, dim, 7)
    asked_of = np.zeros(index.blocks)
    for cells in index.visits(foretold, probes):
        for block in index.blocks_of(cells):
            asked_of[block] += askers / len(foretold)
    index.share_out(asked_of)
    # without a limit every visit yields k rows, so fewer queries are answered at once
    at_once = 4_000 if min_similarity is not None else 500
    held = spark.sparkContext.broadcast(index)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to all parts of the block that holds it, and each query to one part of every block it visits."""
        ix, least_key = held.value, {}
        parts, first_part = ix.parts.tolist(), ix.first_part.tolist()
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):  # no rows, no rounds
                batch = whole.slice(start, 2_000)
                new, again = [], []
                # of the copies of a vector in this task the first asks, and those of ever smaller ids are held
                keys, names = batch.column(1).to_pylist(), batch.column(0).to_pylist()
                for i in sorted(range(len(keys)), key=keys.__getitem__):
                    key, node = keys[i], names[i]
                    if node not in least_key:
                        new.append(i)
                        least_key[node] = key
                    elif key < least_key[node]:
                        again.append(i)
                        least_key[node] = key
                batch = batch.take(pa.array(new + again, pa.int64()))
                x = matrix(batch.column(2), dim)
                node = batch.column(0).to_numpy()
                cell = ix.cells(x)
                own = ix.block[cell] + node % ix.pieces[cell]
                asks = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False)[: len(new)])
                visited = dict(zip(asks.tolist(), ix.visits(x[asks], probes), strict=True))
                out: list[tuple] = []
                for i, (key, home, at) in enumerate(zip(node.tolist(), own.tolist(), cell.tolist(), strict=True)):
                    by = ix.blocks_of(visited.get(i, ()))
                    for p in range(parts[home]):
                        out.append((first_part[home] + p, at, i, by.get(home, []) if p == key % parts[home] else []))
                    for block, cells in by.items():
                        if block != home:
                            out.append((first_part[block] + key % parts[block], -1, i, cells))
                part, at, i, cells = zip(*out, strict=True)
                picked = pa.array(i, pa.int64())
                task = ix.task[np.array(part)]
                yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(part, pa.int32()), pa.array(at, pa.int32()), *(batch.column(c).take(picked) for c in range(3)), pa.array(cells, pa.list_(pa.int32()))], names=["task", "part", "cell", "node", "key", "v", "visits"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, those it holds (cell >= 0) first by cell; the others only ask."""
        part, parts = None, []
        entries = entry_cell = entry_node = order = None

        def answer(batch, x):
            node = batch.column(3).to_numpy()
            q, e, sim = _compare(x, batch.column(6).to_pylist(), entries, entry_cell, k, min_similarity)
            other = node[q] != entry_node[e]
            q, e, sim = q[other], e[other], sim[other]
            best = _top(q, order[e], sim, k)
            q, e, sim = q[best], e[best], sim[best]
            a, b = node[q], entry_node[e]
            if everyone:  # what is found from one side serves the other too
                a, b, sim = np.r_[a, b], np.r_[b, a], np.r_[sim, sim]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim)], names=["node", "other", "similarity"])

        def answers(rows_):
            asking = rows_.filter(pa.array(np.diff(rows_.column(6).offsets.to_numpy()) > 0))
            for s in range(0, asking.num_rows, at_once):
                some = asking.slice(s, at_once)
                yield answer(some, matrix(some.column(5), dim))

        def close():
            nonlocal entries, entry_cell, entry_node, order
            # of copies the one of the least id is compared; whoever asks, asks once for each task that read it
            asking = [b.filter(pa.array(np.diff(b.column(6).offsets.to_numpy()) > 0)) for b in parts]
            rows_ = pa.Table.from_batches(parts).sort_by([("cell", "ascending"), ("node", "ascending"), ("key", "ascending")]).combine_chunks()
            nodes = rows_.column("node").to_numpy()
            rows_ = rows_.filter(pa.array(np.r_[True, nodes[1:] != nodes[:-1]])).combine_chunks()
            entry_cell, entry_node = rows_.column("cell").to_numpy(), rows_.column("node").to_numpy()
            held_rows = rows_.to_batches()
            order = np.unique(np.array(rows_.column("key").to_pylist()), return_inverse=True)[1]
            entries = np.concatenate([matrix(b.column(5), dim) for b in held_rows])
            parts.clear()
            for b in asking:
                yield from answers(b)

        for batch in batches:
            ids, cell = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if not len(ids):
                continue
            edges = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | ((cell[1:] < 0) != (cell[:-1] < 0))])
            for s, e in zip(edges, np.r_[edges[1:], len(ids)], strict=True):
                if ids[s] != part:
                    if parts:
                        yield from close()
                    part, entries = ids[s], None
                some = batch.slice(s, e - s)
                if cell[s] >= 0:
                    parts.append(some)
                else:
                    if parts:
                        yield from close()
                    if entries is not None:
                        yield from answers(some)
        if parts:
            yield from close()

    sent = rows.select("node", F.col("id").alias("key"), "v", "asks").mapInArrow(send, f"task int, part int, cell int, node bigint, key {id_type}, v binary, visits array<int>")
    found = (
        sent.repartitionById(index.tasks, F.col("task")).sortWithinPartitions("part", F.desc("cell"))
        .mapInArrow(search, "node bigint, other bigint, similarity double")
    )
    # ties with the last stay until ids settle them
    best = Window.partitionBy("node").orderBy(F.desc("similarity"))
    near = found.groupBy("node", "other").agg(F.max("similarity").alias("similarity")).withColumn("r", F.rank().over(best)).where(F.col("r") <= k).drop("r")
    if not everyone:
        near = near.join(asked.select("node").distinct(), "node", "left_semi")
    # back to ids: of each vector's copies no one needs more than the first k + 1
    firsts = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    copies = members.groupBy("node").count().where("count > 1").select("node", F.col("node").alias("other"), F.lit(1.0).alias("similarity"))
    ranked = Window.partitionBy("node").orderBy(F.desc("similarity"), "other_id")
    ids = (
        cut(near.unionByName(copies), "near")
        .join(firsts.select(F.col("node").alias("other"), F.col("id").alias("other_id")), "other")
        .withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).select("node", "other_id", "similarity")
    )
    mine = members if everyone else asked
    last = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return (
        mine.join(ids, "node").where("id <> other_id").select("id", F.col("other_id").alias("other"), "similarity")
        .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("id", "other", "rank", "similarity")
    )
