"""Problem 7: test passages inside training texts, by pigeonhole pieces and bit-parallel edit distance.

A passage of n words may be altered by a budget of edits, a share of n. It is
split into at least one piece more than that, of nearly equal lengths and at most
PIECE_WORDS words, so that an altered passage keeps a known number of whole
pieces, at least one; and every run of RUN_WORDS untouched words holds a whole
piece too. Texts are scanned once for the pieces of all passages. Of the pairs
with enough pieces, Myers' bit-parallel edit distance over words says whether the
passage is there whole or altered, and the share of its runs whether a part is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.plans.lineage import cut

from .words import hash_words, sequences

#: Most words of a piece.
PIECE_WORDS = 3
#: Words of a sequence whose occurrence counts as evidence of a part; a run of them holds a whole piece at any offset.
RUN_WORDS = 2 * PIECE_WORDS - 1
#: Passages that every task holds at once; more of them are sought in blocks of about this many, each in a scan of its own.
MAX_ITEMS = 100_000
#: Texts that are scanned at once, and hits of pieces that are held at once.
TEXTS_AT_ONCE = 1_000
HITS_AT_ONCE = 4_000_000


def edit_distance(pattern: list[int], text: list[int]) -> int:
    """Least number of word edits between the pattern and any stretch of the text (Myers 1999, one integer as bit vector)."""
    m = len(pattern)
    if not m:
        return 0
    places: dict[int, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for w in text:
        eq = places.get(w, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp = (down | ~(d0 | up)) & full
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        up = (hn | ~(d0 | hp)) & full
        down = hp & d0
        best = min(best, score)
    return best


def piece_cuts(n: int, budget: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a passage of `n` words: more than `budget`, none longer than PIECE_WORDS."""
    pieces = min(n, max(budget + 1, -(-n // PIECE_WORDS)))
    edges = [n * i // pieces for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Passages:
    """Pieces and runs of all passages, as sorted arrays."""

    def __init__(self, rows: list[tuple[object, str | None]], min_coverage: float, max_error_share: float):
        keep = np.flatnonzero(np.diff(hash_words([p for _, p in rows])[1])).tolist()
        self.ids = [rows[i][0] for i in keep]
        flat, self.offsets = hash_words([rows[i][1] for i in keep])
        self.words = [flat[a:b].astype(np.int64).tolist() for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        lengths = np.diff(self.offsets)
        # an edit spoils a piece; as many edits as words leave no passage
        self.budget = np.minimum(np.floor(max_error_share * lengths + 1e-9), lengths - 1).astype(np.int64)
        cuts = [piece_cuts(int(n), int(e)) for n, e in zip(lengths, self.budget, strict=True)]
        pieces = np.array([len(c) for c in cuts], np.int64)
        shortest = np.array([min(size for _, size in c) for c in cuts], np.int64)
        r, run_item, _ = sequences(flat, self.offsets, RUN_WORDS)
        both = np.unique(np.stack([r, run_item.astype(np.uint64)], 1), axis=0) if len(r) else np.zeros((0, 2), np.uint64)
        self.run_hash, self.run_item = both[:, 0], both[:, 1].astype(np.int64)
        self.runs = np.bincount(self.run_item, minlength=len(keep))
        # a piece lies in at most so many of the runs
        by_runs = np.ceil(min_coverage * self.runs / (RUN_WORDS + 1 - shortest) - 1e-9)
        by_edits = pieces - self.budget
        self.least = np.where(self.runs > 0, np.minimum(np.maximum(by_runs, 1), by_edits), by_edits).astype(np.int64)
        #: of each length of pieces: hashes in order, and the passage of each
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wanted = {size: {(i, a) for i, c in enumerate(cuts) for a, s in c if s == size} for size in {s for c in cuts for _, s in c}}
        for size, places in sorted(wanted.items()):
            h, item, at = sequences(flat, self.offsets, size)
            mine = np.fromiter(((i, a) in places for i, a in zip(item.tolist(), at.tolist(), strict=True)), bool, len(h))
            order = np.argsort(h[mine], kind="stable")
            self.pieces[size] = h[mine][order], item[mine][order]


def _ranges(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = np.searchsorted(table, values, "left")
    return lo, np.searchsorted(table, values, "right") - lo


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of a table: number of the range and place in the table of every entry."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.repeat(lo, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _shares(n: np.ndarray, doc: np.ndarray) -> Iterator[slice]:
    """Stretches of rows (in the order of `doc`) of whole texts that have about HITS_AT_ONCE hits; a text by itself has no more hits than there are pieces."""
    total = np.cumsum(n)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + HITS_AT_ONCE, "right")))
        if end < len(n):
            first = int(np.searchsorted(doc, doc[end - 1 if doc[end - 1] == doc[start] else end]))
            end = first if first > start else int(np.searchsorted(doc, doc[start], "right"))
        yield slice(start, end)
        start = end


def _pairs(flat: np.ndarray, offsets: np.ndarray, p: Passages) -> np.ndarray:
    """Pairs of text and passage (text * passages + passage) that have enough of the passage's pieces."""
    n_items = max(1, len(p.ids))
    rows = []
    for size, (table, _) in p.pieces.items():
        h, doc, _ = sequences(flat, offsets, size)
        lo, n = _ranges(h, table)
        some = n > 0
        # a piece counts once for a text, however often it is there; lo tells equal ones
        rows.append(np.unique(np.stack([doc[some], np.full(some.sum(), size), lo[some], n[some]], 1), axis=0))
    rows = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    out = [np.zeros(0, np.int64)]
    for part in _shares(rows[:, 3], rows[:, 0]):
        mine, counted = rows[part], []
        for size, (_, item) in p.pieces.items():
            of_size = mine[mine[:, 1] == size]
            i, j = _expand(of_size[:, 2], of_size[:, 3])
            counted.append(of_size[i, 0] * n_items + item[j])
        pair, hits = np.unique(np.concatenate(counted), return_counts=True)
        out.append(pair[hits >= p.least[pair % n_items]])
    return np.concatenate(out)


def _stretches(places: np.ndarray, reach: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text within `reach` words of the places of hits, in order, overlapping ones put together."""
    a, b = None, None
    for at in places.tolist():
        lo, hi = max(0, at - reach), min(size, at + reach)
        if a is None:
            a, b = lo, hi
        elif lo <= b:
            b = hi
        else:
            yield a, b
            a, b = lo, hi
    if a is not None:
        yield a, b


def _find(texts: list[str | None], p: Passages, min_coverage: float) -> list[tuple]:
    """Text number, passage number, coverage (None without runs) and distance of what is found in some texts."""
    flat, offsets = hash_words(texts)
    n_items, out = max(1, len(p.ids)), []
    pairs = _pairs(flat, offsets, p)
    if not len(pairs):
        return out
    some = np.unique(pairs // n_items)
    r, run_doc, _ = sequences(flat, offsets, RUN_WORDS)
    mine = np.isin(run_doc, some)
    r, run_doc = r[mine], run_doc[mine]
    run_rows = np.searchsorted(run_doc, np.r_[some, some[-1] + 1])
    starts = np.searchsorted(pairs // n_items, np.r_[some, some[-1] + 1])
    for k, doc in enumerate(some.tolist()):
        own = flat[offsets[doc] : offsets[doc + 1]]
        whole = own.astype(np.int64)
        items = pairs[starts[k] : starts[k + 1]] % n_items
        lo, n = _ranges(np.unique(r[run_rows[k] : run_rows[k + 1]]), p.run_hash)
        _, j = _expand(lo, n)
        covered = np.bincount(p.run_item[j], minlength=n_items)[items]
        hits = {}
        for size, (table, item_of) in p.pieces.items():
            h, _, at = sequences(own, np.array([0, len(own)]), size)
            lo, n = _ranges(h, table)
            found = n > 0
            hits[size] = at[found], lo[found], n[found], item_of
        for item, cover in zip(items.tolist(), covered.tolist(), strict=True):
            pattern, budget = p.words[item], int(p.budget[item])
            share = cover / p.runs[item] if p.runs[item] else None
            places = [at[_holds(item_of, lo, n, item)] for at, lo, n, item_of in hits.values()]
            at = np.unique(np.concatenate(places))
            reach = len(pattern) + budget + PIECE_WORDS
            distance = min(edit_distance(pattern, whole[a:b].tolist()) for a, b in _stretches(at, reach, len(own)))
            if distance <= budget or (share is not None and share >= min_coverage):
                out.append((doc, item, share, distance))
    return out


def _holds(item_of: np.ndarray, lo: np.ndarray, n: np.ndarray, item: int) -> np.ndarray:
    """Which ranges of the table hold the passage; within a range passages are in ascending order."""
    out = np.zeros(len(lo), bool)
    for i, (a, m) in enumerate(zip(lo.tolist(), n.tolist(), strict=True)):
        k = a + int(np.searchsorted(item_of[a : a + m], item))
        out[i] = k < a + m and item_of[k] == item
    return out


SCHEMA = "coverage double, distance int, passage_words int, form string"


def leaked_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage",
    min_coverage: float = 0.25, max_error_share: float = 0.25,
) -> DataFrame:
    """`doc_id, item_id, coverage DOUBLE, distance INT, passage_words INT, form STRING` of every text that holds a passage or part of it.

    `distance` is the least number of word edits that turn the passage into a
    stretch of the text near its pieces. With distance 0 the `form` is `whole`;
    with at most `max_error_share` of the passage's words it is `altered`; else
    the pair is listed as `part` if the `coverage`, the share of the passage's
    distinct five-word sequences that occur in the text, is at least
    `min_coverage`. No such pair is missed: the number of pieces asked for
    follows from both limits.

    A passage under five words has no sequences, thus no coverage (null), and is
    found by distance alone; one without a word is never found. Null texts,
    passages or ids give no rows; repeated rows give one row; of several passages
    of one item the best counts; empty tables give none. More than MAX_ITEMS
    passages are sought in several scans. The output columns are always named
    doc_id and item_id; other input columns are ignored.
    """
    held = items.select(F.col(item_col).alias("item_id"), F.col(passage_col).alias("passage")).where("item_id is not null and passage is not null").distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    many = held.count()
    if many <= MAX_ITEMS:
        found = _scan(texts, held, min_coverage, max_error_share)
    else:
        blocks = -(-many * 5 // (MAX_ITEMS * 4))
        number = F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks))
        found = None
        for b in range(blocks):
            part = cut(_scan(texts, held.where(number == b), min_coverage, max_error_share), "leaks")
            found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("coverage", "distance", "passage_words", "form"), F.struct(F.coalesce("coverage", F.lit(-1.0)), -F.col("distance"), -F.col("passage_words")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _scan(texts: DataFrame, held: DataFrame, min_coverage: float, max_error_share: float) -> DataFrame:
    """All findings of a block of passages, which every task holds."""
    rows = sorted(((r.item_id, r.passage) for r in held.collect()), key=lambda r: (str(r[0]), r[1]))
    shared = texts.sparkSession.sparkContext.broadcast(Passages(rows, min_coverage, max_error_share))
    id_type, item_type = texts.schema["doc_id"].dataType.simpleString(), held.schema["item_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(start, TEXTS_AT_ONCE)
                out = _find(batch.column(1).to_pylist(), p, min_coverage)
                if out:
                    d, item, share, distance = zip(*out, strict=True)
                    form = ["whole" if not x else "altered" if x <= p.budget[i] else "part" for i, x in zip(item, distance, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d)), pa.array([p.ids[i] for i in item]), pa.array(share, pa.float64()), pa.array(distance, pa.int32()), pa.array([len(p.words[i]) for i in item], pa.int32()), pa.array(form)],
                        names=["doc_id", "item_id", "coverage", "distance", "passage_words", "form"],
                    )

    return texts.mapInArrow(scan, f"doc_id {id_type}, item_id {item_type}, {SCHEMA}")
