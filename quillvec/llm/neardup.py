"""Problem 4: records that repeat another record's text with small edits, by an exact prefix filter.

All distinct word sequences have one order: the seldom ones first, by hash, and
then those that a sample shows to be frequent. A similarity of at least t takes
an overlap of t / (1 + t) of the summed sizes, and at least t of either set, so
two texts within the limit share at least m sequences among the first
n - ceil(t n) + m of the n of each (all, if they share fewer). The order decides how many candidates there are, never which
links are found. Texts are joined on those sequences, pairs that meet in m of
them are candidates, the sketch of bits prunes
the pairs, and the sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.plans.lineage import cut

from .components import connected_components
from .words import hash_words, mix, run_hashes, sequences

#: Bits of the pruning sketch.
SKETCH_BITS = 512
#: Texts in the sample that finds frequent sequences, the sampled texts that make one frequent, and how many are named at most: the bound of the broadcast.
SAMPLE_ROWS = 20_000
FREQUENT_TEXTS = 2
FREQUENT_LIMIT = 250_000
#: Sequences in which a pair has to meet; chance meetings in one are many.
MEETINGS = 2
#: What bounds may be off by, always to the side of one candidate more.
SLACK = 1e-6
#: Pairs with rows kept from earlier batches that are looked at at once, and pairs that are held before they are passed on.
BLOCK = 1_000_000
PAIRS_HELD = 500_000


def _text_sets(ids, titles, plots, words: int, min_words: int):
    """Of the rows whose plot has enough words: row number, hash of the whole word sequence, and the distinct sequences of each."""
    some = [i for i, plot in enumerate(plots) if ids[i] is not None and plot]
    in_title = np.diff(hash_words([titles[i] for i in some])[1])
    flat, offsets = hash_words([f"{titles[i] or ''}\n{plots[i]}" for i in some])
    count = np.diff(offsets)
    enough = count - in_title >= min_words
    rows = np.array(some, np.int64)[enough]
    flat = flat[np.repeat(enough, count)]
    offsets = np.r_[0, np.cumsum(count[enough])]
    node = run_hashes(flat, offsets[:-1], offsets[1:]).astype(np.int64)
    h, text, _ = sequences(flat, offsets, words)
    # 44 bits of hash and the text number in one integer, which sorts fast
    both = np.sort((text.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    text, h = (both >> np.uint64(44)).astype(np.int64), both & np.uint64((1 << 44) - 1)
    return rows, node, h, text, np.bincount(text, minlength=len(rows))


def join_keys(h: np.ndarray, text: np.ndarray, sizes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], threshold: float):
    """Text number, sequence and place of the sequences each text is joined on: the first of its sequences in the common order, as many as a match can't do without.

    `frequent` has sorted hashes and the rank of each, from 1. Sequences come sorted by text and hash.
    """
    known, rank = frequent
    level = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        level = np.where(known[at] == h, rank[at], 0)
    order = np.argsort((text << 20) | level, kind="stable")  # by hash within a level
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = (sizes - np.ceil(threshold * sizes - SLACK) + MEETINGS)[text]
    keep = place < first
    return text[keep], h[order][keep].astype(np.int64), place[keep]


def _sketches(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A row of SKETCH_BITS / 8 bytes for each text: the parity of the sequences that fall on each bit."""
    bit = (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = np.bincount(text * SKETCH_BITS + bit, minlength=n * SKETCH_BITS) & 1
    return np.packbits(parity.reshape(n, SKETCH_BITS).astype(np.uint8), axis=1)


def _binary(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows]


def _key_pairs(threshold: float):
    """All pairs of texts that share a key and may be within the limit, with the number of keys and the number that they have to meet in, from rows (key, size, place, node) sorted by key, size and node.

    From its first shared sequence on, a pair can't share more than either text
    has left there; that must reach the least overlap for the two sizes, and one
    less for each shared sequence after the first.
    """
    share = threshold / (1 + threshold)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64) for _ in range(4)]  # of the last key, what later rows may still be paired with: key, size, left, node
        last = None  # key and node of the row before
        out: list[np.ndarray] = []

        def found(a, b, size, left, node):
            """The pairs of those rows that pass the bounds."""
            need = np.ceil(share * (size[0][a] + size[1][b]) - SLACK)
            good = (left[0][a] > need - MEETINGS) & (left[1][b] > need - MEETINGS) & (size[0][a] >= threshold * size[1][b] - SLACK)
            x, y = node[0][a[good]], node[1][b[good]]
            return np.stack([np.minimum(x, y), np.maximum(x, y), np.minimum(need[good], MEETINGS).astype(np.int64)], 1)

        def passed_on() -> pa.RecordBatch:
            pairs = np.concatenate([np.zeros((0, 3), np.int64), *out])
            out.clear()
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            start = np.flatnonzero(np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(1)][: len(pairs)])
            met = np.diff(np.r_[start, len(pairs)])
            a, b, least = pairs[start].T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(met, pa.int32()), pa.array(least, pa.int32())], names=["a", "b", "met", "least"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, size, place, node = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            again = (key == np.r_[key[0] if last is None else last[0], key[:-1]]) & (node == np.r_[~node[0] if last is None else last[1], node[:-1]])
            last = key[-1], node[-1]
            key, size, left, node = (x[~again] for x in (key, size, size - place, node))  # equal texts of other tasks
            if not len(key):
                continue
            held = 0
            on = int(np.searchsorted(key != kept[0][0], True)) if len(kept[0]) else 0  # rows that go on with the kept key
            step = max(1, BLOCK // max(1, len(kept[0])))
            for s in range(0, on, step):
                n = min(step, on - s)
                a, b = np.repeat(np.arange(len(kept[0])), n), np.tile(np.arange(s, s + n), len(kept[0]))
                out.append(found(a, b, (kept[1], size), (kept[2], left), (kept[3], node)))
                held += len(out[-1])
                if held > PAIRS_HELD:
                    yield passed_on()
                    held = 0
            # the smaller of two texts needs most of itself left, whatever the size of the other
            first = left > np.ceil(share * 2 * size - SLACK) - MEETINGS
            a, off = np.flatnonzero(first), 1
            while len(a):
                a = a[a + off < len(key)]
                a = a[(key[a + off] == key[a]) & (size[a] >= threshold * size[a + off] - SLACK)]
                if len(a):
                    out.append(found(a, a + off, (size, size), (left, left), (node, node)))
                    held += len(out[-1])
                    if held > PAIRS_HELD:
                        yield passed_on()
                        held = 0
                off += 1
            mine = (key == key[-1]) & first
            if len(kept[0]) and kept[0][0] == key[-1]:
                kept = [np.r_[k, x[mine]] for k, x in zip(kept, (key, size, left, node), strict=True)]
            else:
                kept = [x[mine] for x in (key, size, left, node)]
            kept = [x[kept[1] >= threshold * size[-1] - SLACK] for x in kept]
            yield passed_on()

    return pair


def near_duplicate_links(
    df: DataFrame, id_col: str = "doc_id", title_col: str = "title", text_col: str = "plot",
    words: int = 5, threshold: float = 0.8, min_words: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """The texts of `df` and the links between different texts.

    Returns `members(id, node)`, the ids and the 64-bit hash of their text's word
    sequence, for the rows whose text has at least `min_words` words; and
    `links(a, b)`, nodes whose sets of `words` consecutive words of title, blank
    and text have a Jaccard similarity of at least `threshold`. A null title is
    empty; a null or shorter text, or a null id, takes no part. Repeated rows
    count once; equal texts share a node and need no link.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))

    def sets(batch: pa.RecordBatch):
        return _text_sets(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), words, min_words)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, node, h, text, sizes = sets(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(node, pa.int64()), pa.array(sizes, pa.int32()), pa.array(_binary(_sketches(h, text, len(sizes))), pa.binary())], names=["id", "node", "size", "sketch"])

    id_type = rows.schema["id"].dataType.simpleString()
    described = cut(rows.mapInArrow(nodes, f"id {id_type}, node bigint, size int, sketch binary"), "texts")
    members = described.select("id", "node").distinct()
    frequent = _frequent(rows, words, min_words)
    shared = spark.sparkContext.broadcast(frequent)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            _, node, h, text, sizes = sets(batch)
            t, k, place = join_keys(h, text, sizes, shared.value, threshold)
            fresh = np.zeros(len(node), bool)  # equal texts of a task give their keys once
            for i, x in enumerate(node.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            t, k, place = (x[fresh[t]] for x in (t, k, place))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(sizes[t], pa.int32()), pa.array(place, pa.int32()), pa.array(node[t], pa.int64())], names=["key", "size", "place", "node"])

    keyed = rows.mapInArrow(keys, "key bigint, size int, place int, node bigint")
    candidates = (
        keyed.repartition("key").sortWithinPartitions("key", "size", "node")
        .mapInArrow(_key_pairs(threshold), "a bigint, b bigint, met int, least int")
        .groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("least").alias("least")).where("met >= least").select("a", "b")
    )
    candidates = cut(candidates, "candidates")  # frees the keys' shuffle, by far the largest, before the next one comes
    sketches = described.select("node", "size", "sketch").dropDuplicates(["node"])
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(n, -1) for c in ("sketch_a", "sketch_b")]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1)
            summed = sum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size_a", "size_b"))
            near = apart <= (1 - threshold) / (1 + threshold) * summed + 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(near))

    near = cut(candidates.join(side("a"), "a").join(side("b"), "b").mapInArrow(prune, "a bigint, b bigint"), "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = members.groupBy("node").agg(F.min("id").alias("id")).join(wanted, "node").select("id")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, node, h, text, sizes = sets(batch)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), lists], names=["node", "items"])

    exact = rows.join(first, "id", "left_semi").mapInArrow(contents, "node bigint, items array<bigint>").dropDuplicates(["node"])
    pairs = near.join(exact.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(exact.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    shared_items = F.size(F.array_intersect("x", "y"))
    links = pairs.where(shared_items >= F.lit(threshold) * (F.size("x") + F.size("y") - shared_items)).select("a", "b")
    return members, links


def _frequent(rows: DataFrame, words: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences that occur in many of the sampled texts, sorted, and their ranks from the seldom to the frequent; they make poor keys. The rule is the same at every size, and the sample only sets the order, so it decides no result."""
    n = rows.count()
    sample = rows if n <= SAMPLE_ROWS else rows.sample(fraction=SAMPLE_ROWS / n, seed=29)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, h, _, _ = _text_sets(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), words, min_words)
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    found = (
        sample.mapInArrow(hashes, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT_TEXTS)
        .orderBy(F.desc("n"), "h").limit(FREQUENT_LIMIT).select("h").toPandas()
    )
    h = found["h"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", title_col: str = "title", text_col: str = "plot", words: int = 5, threshold: float = 0.8, min_words: int = 20) -> DataFrame:
    """`id, group_id`: every distinct id with the least id of what links connect it to, directly or through others.

    Ids whose texts are null or shorter than `min_words` words stay alone, as do
    ids without a partner. Null ids are dropped, repeated rows give one row, an
    empty table gives none, and other columns are ignored.
    """
    members, links = near_duplicate_links(df, id_col, title_col, text_col, words, threshold, min_words)
    found = connected_components(links).withColumnRenamed("component", "root")
    rooted = members.join(found, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("group_id"))
    grouped = rooted.join(least, "root").groupBy("id").agg(F.min("group_id").alias("group_id"))
    ids = df.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    return ids.join(grouped, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
