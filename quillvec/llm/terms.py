"""Problem 3: how often each distinct term occurs, by heavy-light aggregation.

Terms that a bounded sample of the records shows to be frequent are heavy: they
are broadcast, and each task counts them exactly in two local arrays. All other
terms are light: only they are shuffled by term. The sample decides nothing but
the path a term takes; either path counts every record.

A repeated record must count once. Only ids are shuffled to find those that
occur twice; a bit filter of them, of bounded size, goes to every task, which
counts all other records where they lie and passes the few that hit the filter
on to be settled by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.plans.lineage import cut

from .words import mix

#: Records in the sample that detects heavy terms, and the most terms it may name: the bound of what is broadcast.
SAMPLE_ROWS = 20_000
HEAVY_LIMIT = 4_096
#: Share of the sampled records in which a term occurs for it to be heavy.
HEAVY_SHARE = 0.002
#: Distinct light terms that a task holds before it hands them on.
LOCAL_TERMS = 200_000
#: Bits of the filter for each repeated id, and at most (32 MB): beyond it more records pass for repeated, which only costs their shuffle.
ID_BITS = 16
MOST_BITS = 1 << 28


NAMES = ["term", "heavy", "occurrences", "records", "id", "tokens"]


def _clean(values: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.utf8_trim_whitespace(values))


class Repeated:
    """A Bloom filter of ids that occur more than once, by their 64-bit hashes."""

    def __init__(self, ids: int):
        self.bits = 64 if ids < 4 else min(MOST_BITS, 1 << (ID_BITS * ids - 1).bit_length())
        self.words = np.zeros(self.bits // 64, np.uint64) if ids else None

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(3):
            yield mix(h.astype(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(self.bits - 1)

    def add(self, h: np.ndarray) -> None:
        for at in self.places(h):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        found = np.full(len(h), self.words is not None)
        if self.words is not None:
            for at in self.places(h):
                found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _repeated_ids(records: DataFrame) -> Repeated:
    """The filter of the ids that several records have. Only ids and their numbers are shuffled."""
    twice = cut(records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("id").alias("h")), "repeated")
    n = twice.count()
    out = Repeated(n)
    if n:

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Repeated(n)
            for batch in batches:
                own.add(batch.column(0).to_numpy())
            at = np.flatnonzero(own.words)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.words[at].view(np.int64))], names=["at", "bits"])

        words = twice.mapInArrow(fill, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        out.words[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _unseen(ids: list, seen: set) -> np.ndarray:
    """Row numbers of the ids that are not in `seen`, each once; they are put into it."""
    keep = []
    for i, key in enumerate(ids):
        if key not in seen:
            seen.add(key)
            keep.append(i)
    return np.array(keep, np.int64)


def _heavy_terms(records: DataFrame) -> list[str]:
    n = records.count()
    if not n:
        return []
    sample = records if n <= SAMPLE_ROWS else records.sample(fraction=min(1.0, SAMPLE_ROWS / n), seed=17)
    floor = max(2, int(HEAVY_SHARE * min(n, SAMPLE_ROWS)))
    rows = (
        sample.select(F.explode(F.array_distinct("tokens")).alias("raw"))
        .groupBy("raw").count().where(F.col("count") >= floor)
        .orderBy(F.desc("count"), "raw").limit(HEAVY_LIMIT).collect()
    )
    return sorted({str(t) for t in _clean(pa.array([r.raw for r in rows], pa.string())).to_pylist() if t})


def term_counts(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """`term STRING, occurrences BIGINT, records BIGINT, total_records BIGINT`: exact counts of every term.

    A term is a token trimmed of white space (of any script) and lower-cased;
    blank and null tokens don't count. Each id counts once (repeated rows are
    taken to hold the same content); a row whose id is null is dropped. Records
    whose token array is null or empty count nowhere, also not in
    `total_records`; one whose tokens are all blank counts in it. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    records = df.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens")).where(F.col("id").isNotNull() & (F.size("tokens") > 0))
    id_type = records.schema["id"].dataType.simpleString()
    heavy = _heavy_terms(records)
    shared = spark.sparkContext.broadcast((heavy, _repeated_ids(records)))

    def count(batches: Iterator[pa.RecordBatch], settled: bool) -> Iterator[pa.RecordBatch]:
        """Counts of the records (id, tokens, hash of the id), and as rows with tokens those that may be repeated, unless all are settled."""
        heavy_names, repeated = shared.value
        heavy_terms = pa.array(heavy_names, pa.string())
        occurrences, in_records = np.zeros(len(heavy_terms), np.int64), np.zeros(len(heavy_terms), np.int64)
        light: dict[str, list[int]] = {}
        total, seen, arrow_id, arrow_tokens = 0, set(), pa.null(), pa.list_(pa.string())

        def out(terms, slots, occ, rec):
            n = len(terms)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(slots, pa.int32()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64()), pa.nulls(n, arrow_id), pa.nulls(n, arrow_tokens)], names=NAMES)

        def flush():
            batch = out(list(light), [None] * len(light), [v[0] for v in light.values()], [v[1] for v in light.values()])
            light.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            arrow_id, arrow_tokens = batch.schema.field(0).type, batch.schema.field(1).type
            if settled:
                batch = batch.take(pa.array(_unseen(batch.column(0).to_pylist(), seen)))
            else:
                unsure = repeated.may_hold(batch.column(2).to_numpy())
                held = batch.filter(pa.array(unsure))
                held = held.take(pa.array(_unseen(held.column(0).to_pylist(), seen)))
                if held.num_rows:
                    n = held.num_rows
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), held.column(0), held.column(1)], names=NAMES)
                batch = batch.filter(pa.array(~unsure))
            total += batch.num_rows
            lists = batch.column(1)
            record = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            coded = _clean(pc.list_flatten(lists)).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False) if not coded.null_count else coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            terms = coded.dictionary
            k = len(terms)
            if not k:
                continue
            record, codes = record[codes >= 0], codes[codes >= 0].astype(np.int64)
            occ = np.bincount(codes, minlength=k)
            rec = np.bincount(np.unique(record.astype(np.int64) * k + codes) % k, minlength=k)
            slot = pc.index_in(terms, heavy_terms).fill_null(-1).to_numpy(zero_copy_only=False)
            is_heavy = slot >= 0
            occurrences[slot[is_heavy]] += occ[is_heavy]
            in_records[slot[is_heavy]] += rec[is_heavy]
            names = terms.to_pylist()
            for i in np.flatnonzero(~is_heavy):
                if names[i]:
                    have = light.get(names[i])
                    if have is None:
                        light[names[i]] = [int(occ[i]), int(rec[i])]
                    else:
                        have[0] += int(occ[i])
                        have[1] += int(rec[i])
            if len(light) > LOCAL_TERMS:
                yield flush()
        if arrow_id == pa.null():  # no rows
            return
        if light:
            yield flush()
        slots = np.flatnonzero(in_records)
        yield out([None] * (len(slots) + 1), [-1, *slots.tolist()], [0, *occurrences[slots].tolist()], [total, *in_records[slots].tolist()])

    schema = f"term string, heavy int, occurrences bigint, records bigint, id {id_type}, tokens array<string>"
    # one round over the records serves all tables below, which would else count everything again
    first = cut(records.select("id", "tokens", F.xxhash64("id").alias("h")).mapInArrow(lambda batches: count(batches, False), schema), "terms")
    unsure = first.where("tokens is not null").select("id", "tokens").repartition("id")
    counted = first.where("tokens is null").unionByName(cut(unsure.mapInArrow(lambda batches: count(batches, True), schema), "terms"))
    sums = (F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    by_slot = counted.where("heavy is not null").groupBy("heavy").agg(*sums)
    names = spark.createDataFrame([(i, t) for i, t in enumerate(heavy)], "heavy int, term string")
    heavy_counts = by_slot.join(F.broadcast(names), "heavy").select("term", "occurrences", "records")
    light_counts = counted.where("heavy is null").groupBy("term").agg(*sums)
    total = by_slot.where("heavy = -1").select(F.col("records").alias("total_records"))
    return heavy_counts.unionByName(light_counts).crossJoin(F.broadcast(total))


def term_mark(common_share: float = 0.2, rare_records: int = 3, rare_occurrences: int = 5) -> Column:
    """`common`, `rare` or null over the columns of `term_counts`; common goes first."""
    return (
        F.when(F.col("records") > F.col("total_records") * F.lit(common_share), "common")
        .when((F.col("records") < rare_records) | (F.col("occurrences") < rare_occurrences), "rare")
    )
