"""Problem 8: how demanding texts are to read, by harmonic propagation over a text-word graph.

Texts and words are the two sides of a graph. Graded texts are clamped (0 easy,
0.5 middle, 1 hard); every other node takes the weighted mean of its neighbours,
and a weak tie to the middle keeps words that few graded texts reach near it. A
round is one pass over the texts: each task turns the word values it holds into
text values and adds those up for the words. Words are hashed into a fixed
number of nodes, so that what is broadcast and gathered has a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.plans.lineage import cut

#: Word nodes; a word is a maximal run of letters, hashed into one of them.
NODES = 1 << 18
#: Harmonic rounds, and the weight of each word's tie to the middle in texts.
ROUNDS = 8
TIE = 0.5
#: Last rounds without clamps: else the rare words of graded texts keep their grades, and graded texts look further apart than others of their band.
FREE_ROUNDS = 2
#: Words of a stretch of text that is judged by itself, and the share of stretches that must be of a band for the text to be of it throughout.
STRETCH = 20
THROUGHOUT = 0.75
#: Limits of the bands on the scale on which graded easy, middle and hard texts lie at 0, 0.5 and 1.
EASY_BELOW, HARD_ABOVE = 0.28, 0.8
#: Graded texts used at most, those of the least ids (a bounded sample of labelled rows).
MAX_GRADED = 10_000
GRADES = {"easy": 0.0, "middle": 0.5, "hard": 1.0}
_LETTERS = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"</?[a-z!?][^<>]*>|&[a-z]+;", re.I)


class _Nodes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word) % NODES
        return n


def _nodes_of(text: str, cache: _Nodes) -> np.ndarray:
    return np.array([cache[w] for w in _LETTERS.findall(_TAG.sub(" ", text).lower())], np.int32)


def _sums(values: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    total = np.r_[0.0, np.cumsum(values)]
    return total[ends[1:]] - total[ends[:-1]]


def _gather(rows: DataFrame) -> np.ndarray:
    """`node, value` summed by node: at most NODES numbers reach the driver."""
    table = rows.groupBy("node").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(NODES)
    out[table["node"].to_numpy(np.int64)] = table["value"].to_numpy(float)
    return out


def _node_rows(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["node", "value"])


def reading_levels(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", band_col: str = "band", rounds: int = ROUNDS) -> DataFrame:
    """`doc_id, difficulty DOUBLE, easy_share DOUBLE, hard_share DOUBLE, words INT, band STRING` of every English text.

    English is a language code that begins with `en` in any case. `difficulty`
    is the propagated value, rescaled so that graded easy, middle and hard texts
    lie around 0, 0.5 and 1 (their own clamp left aside); the shares are of the
    text's stretches nearer to easy than to middle, and nearer to hard than to
    middle. `band` is easy or hard where the text and most of its stretches are,
    else middle. Texts without a letter, null ones, and null ids give no row;
    rows of other or null languages neither. Repeated rows give one row. Grades
    of unknown bands or texts are ignored; without an easy, a middle and a hard
    graded text the difficulty stays null and the band too.
    """
    spark = docs.sparkSession
    english = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .where("doc_id is not null and text is not null and lower(lang) like 'en%'").select("doc_id", "text")
    )
    grades = (
        graded.select(F.col(id_col).alias("doc_id"), F.trim(F.lower(band_col)).alias("band")).where(F.col("band").isin(list(GRADES)))
        .groupBy("doc_id").agg(F.min("band").alias("band")).orderBy("doc_id").limit(MAX_GRADED)
    )
    clamp = {r.doc_id: GRADES[r.band] for r in grades.collect()}
    known = spark.sparkContext.broadcast(clamp)
    id_type = english.schema["doc_id"].dataType.simpleString()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Nodes()
        for batch in batches:
            lists = [np.unique(_nodes_of(t, cache)) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            grade = [known.value.get(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(grade, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["grade", "nodes"])

    graph = cut(english.mapInArrow(link, "grade double, nodes array<int>").where(F.size("nodes") > 0), "graph")

    def degree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(NODES)
        for batch in batches:
            total += np.bincount(batch.column(1).flatten().to_numpy(), minlength=NODES)
        yield _node_rows(total)

    degrees = _gather(graph.mapInArrow(degree, "node int, value double"))
    n_docs = max(1, graph.count())
    weights = np.log1p(n_docs / np.maximum(degrees, 1.0))
    value = np.full(NODES, 0.5)
    for round_ in range(rounds if clamp else 0):
        held = spark.sparkContext.broadcast((weights, value, round_ < rounds - FREE_ROUNDS))

        def step(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            w, v, clamped = held.value
            total = np.zeros(NODES)
            for batch in batches:
                lists = batch.column(1)
                at = lists.flatten().to_numpy()
                of_text = _sums(w[at] * v[at], lists) / _sums(w[at], lists)
                grade = batch.column(0).to_numpy(zero_copy_only=False)
                of_text = np.where(np.isnan(grade), of_text, grade) if clamped else of_text
                total += np.bincount(at, weights=np.repeat(of_text, np.diff(lists.offsets.to_numpy())), minlength=NODES)
            yield _node_rows(total)

        summed = _gather(graph.mapInArrow(step, "node int, value double"))
        value = np.where(degrees > 0, (summed + TIE * 0.5) / (degrees + TIE), 0.5)
        held.unpersist()
    held = spark.sparkContext.broadcast((weights.astype(np.float32), value.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, v = (x.astype(float) for x in held.value)
        cache = _Nodes()
        for batch in batches:
            ids, level, stretches, words = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                at = _nodes_of(text, cache)
                if not len(at):
                    continue
                n = max(1, len(at) // STRETCH)
                cuts = np.arange(n) * STRETCH
                each = np.add.reduceat(w[at] * v[at], cuts) / np.add.reduceat(w[at], cuts)
                ids.append(i)
                level.append(float((w[at] * v[at]).sum() / w[at].sum()))
                stretches.append(each.tolist())
                words.append(len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(level, pa.float64()), pa.array(stretches, pa.list_(pa.float64())), pa.array(words, pa.int32())], names=["doc_id", "level", "stretches", "words"])

    scored = english.mapInArrow(score, f"doc_id {id_type}, level double, stretches array<double>, words int")
    anchors = {}
    if clamp:
        rows = english.join(F.broadcast(grades), "doc_id").select("doc_id", "text").mapInArrow(score, scored.schema).select("doc_id", "level").collect()
        for grade in GRADES.values():
            levels = [r.level for r in rows if clamp.get(r.doc_id) == grade]
            if levels:
                anchors[grade] = float(np.median(levels))
    if len(anchors) < len(GRADES) or not anchors[0.0] < anchors[0.5] < anchors[1.0]:
        nothing = F.lit(None)
        return scored.select("doc_id", nothing.cast("double").alias("difficulty"), nothing.cast("double").alias("easy_share"), nothing.cast("double").alias("hard_share"), "words", nothing.cast("string").alias("band")).dropDuplicates(["doc_id"])
    e, m, h = anchors[0.0], anchors[0.5], anchors[1.0]
    scaled = lambda x: F.when(x < m, F.greatest(F.lit(0.0), 0.5 * (x - e) / (m - e))).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * (x - m) / (h - m)))
    share = lambda good: F.size(F.filter("stretches", good)) / F.size("stretches")
    easy, hard = share(lambda x: x < F.lit((e + m) / 2)), share(lambda x: x > F.lit((m + h) / 2))
    out = scored.select("doc_id", scaled(F.col("level")).alias("difficulty"), easy.alias("easy_share"), hard.alias("hard_share"), "words")
    band = (
        F.when((F.col("difficulty") < EASY_BELOW) & (F.col("easy_share") >= THROUGHOUT), "easy")
        .when((F.col("difficulty") > HARD_ABOVE) & (F.col("hard_share") >= THROUGHOUT), "hard").otherwise("middle")
    )
    return out.withColumn("band", band).dropDuplicates(["doc_id"])
