"""Problem 2: text statistics of each record, and the structural profile its text is nearest to.

A text is cut into stretches of some twenty words. Three distributions of each
are compared with those of prose and of lists, tables, markup and noise, by
Jensen-Shannon divergence: over classes of characters (vowels and other letters
apart), over the lengths of the unbroken runs in which its words stand, and over
function and content words. The nearest profile gets the stretch, and the profile
that holds most characters is the text's.

Which words are function words is learnt from the whole collection, in whatever
languages it has: words that stand in long runs far more often than in the short
ones of lists. A word that the collection says too little of doesn't count, so that
a text in a language that it hardly holds is judged by its characters and runs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILES = ("prose", "list", "table", "markup", "noise", "noise", "noise")
#: Assumed shares of vowels, other letters, digits, white space, punctuation of sentences, and other symbols. The last two profiles are letters at random and codes.
CHARACTERS = np.array([
    (0.325, 0.48, 0.005, 0.165, 0.024, 0.001),
    (0.31, 0.47, 0.01, 0.14, 0.06, 0.01),
    (0.16, 0.26, 0.28, 0.16, 0.08, 0.06),
    (0.25, 0.37, 0.06, 0.12, 0.05, 0.15),
    (0.08, 0.12, 0.1, 0.1, 0.1, 0.5),
    (0.15, 0.655, 0.005, 0.165, 0.024, 0.001),
    (0.12, 0.24, 0.58, 0.05, 0.005, 0.005),
])
#: Assumed shares of words in runs of one, two, three or four, five to eight, and more words.
RUNS = np.array([(0.02, 0.03, 0.1, 0.3, 0.55), (0.35, 0.35, 0.2, 0.08, 0.02), (0.6, 0.25, 0.1, 0.04, 0.01), (0.5, 0.3, 0.14, 0.05, 0.01), (0.2, 0.2, 0.2, 0.2, 0.2), (0.02, 0.03, 0.1, 0.3, 0.55), (0.02, 0.03, 0.1, 0.3, 0.55)])
#: Assumed shares of function words among the words that the collection knows.
FUNCTION_SHARE = np.array([0.45, 0.02, 0.02, 0.02, 0.1, 0.45, 0.45])
#: Weights of the distributions of characters, runs and words; that of words counts by the share of words that are known.
WEIGHTS = (0.8, 0.5, 2.0)
STRETCH_WORDS = 20
#: Words of the whole text's distributions mixed into those of a stretch, whose few words say little by themselves.
SHRINK_WORDS = 10
#: Runs of so many words and more are running text, of so few and less listed, in a record that mostly has such runs; a function word's share of running words is so many times that of listed ones.
RUNNING, LISTED, RATIO = 5, 2, 4.0
#: Records that a known word stands in, the most known words (the bound of what is broadcast), records in which a content word is listed, and listed words that are assumed before any are seen.
KNOWN_RECORDS, KNOWN_WORDS, CONTENT_RECORDS, PRIOR_LISTED = 5, 20_000, 2, 1_000
#: Words that a task holds before it hands their numbers on.
LOCAL_WORDS = 200_000
#: Words within which repetition is measured, so that the length of a text doesn't count, and the share of distinct pairs of words below which nothing is said.
REPEAT_WORDS, REPEATED = 100, 0.2
# Vowels of the Latin (without marks), Greek and Cyrillic scripts.
_VOWELS = set("aeiouyıøæœαεηιουωаеиоуыэюяєіїё")
_PUNCTUATION = set(".,;:!?\"'()…“”‘’«»–—-、。，！？「」『』・¿¡")
_TAG = re.compile(r"</?[a-z!?][^<>]*>|&#?[a-z0-9]+;|https?://\S+", re.I)
_CLOSING = re.compile(r"[.!?…。！？][\"'”’»)」』]*\s*$")
#: Scripts written without blanks, of which two characters count as a word.
_UNSPACED = "぀-ヿ㐀-鿿฀-໿က-႟ក-៿"
#: A word, or (second group) what ends a run of words: punctuation, a line break, or a dash between blanks.
_TOKEN = re.compile(rf"([{_UNSPACED}]{{1,2}}|[^\W_{_UNSPACED}]+(?:['’\-][^\W\d_{_UNSPACED}]+)*)|([^\w\s'’\"“”«»]|_|[\n\r\t])")


class _Classes(dict):
    """Character code to the letter of its class, for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isalpha():
            base = unicodedata.normalize("NFD", c.lower())[0]
            known = unicodedata.name(base, "").split(" ")[0] in ("LATIN", "GREEK", "CYRILLIC")
            # letters of other scripts are spread as prose spreads them
            kind = ("v" if base in _VOWELS else "l") if known else ("v" if code % 5 < 2 else "l")
        else:
            kind = "d" if c.isdigit() else "s" if c.isspace() else "p" if c in _PUNCTUATION else "y"
        self[code] = kind
        return kind


def _runs(tokens: list[re.Match]) -> tuple[list[re.Match], list[int]]:
    """The words, and the length of the run that each stands in."""
    words, lengths, n = [], [], 0
    for m in tokens:
        if m.lastindex == 1:
            words.append(m)
            n += 1
        elif n:
            lengths += [n] * n
            n = 0
    return words, lengths + [n] * n


def _bare(text: str) -> str:
    """The text without markup, and line breaks of one kind."""
    return _TAG.sub(" ", text).replace("\r\n", "\n")


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits, row by row against each row of `q`: rows x profiles."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(2)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(2)
    return (left + right) / 2


class Profiler:
    """Measures texts; `known` says of each known word whether it is a function word."""

    def __init__(self, known: dict[str, bool] | None = None):
        self.kind = {w: 0 if function else 1 for w, function in (known or {}).items()}
        self.classes = _Classes()

    def _counts(self, text: str) -> tuple[dict, np.ndarray]:
        """Statistics, and for each stretch numbers of characters by class (6), words by run (5), and function, content and unknown words (3)."""
        lines = [x for x in text.splitlines() if x.strip()]
        out = {"chars": len(text), "lines": len(lines), "closed_lines": sum(bool(_CLOSING.search(x)) for x in lines) / max(1, len(lines))}
        bare = _bare(text)
        out["removed"] = 1 - len("".join(bare.split())) / max(1, len("".join(text.split())))
        found, runs = _runs(list(_TOKEN.finditer(bare)))
        words = [m.group().lower() for m in found]
        n = len(words)
        kinds = [self.kind.get(w, 2) for w in words]
        starts = list(range(0, max(n, 1), STRETCH_WORDS))
        if len(starts) > 1 and n - starts[-1] < STRETCH_WORDS // 2:
            starts.pop()
        cuts = [0, *(found[s].start() for s in starts[1:]), len(bare)]
        classes = bare.translate(self.classes)
        counts = np.zeros((len(starts), 14))
        by_run = np.searchsorted((1, 2, 4, 8), runs)
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else n
            counts[k, :6] = [classes.count(c, cuts[k], cuts[k + 1]) for c in "vldspy"]
            counts[k, 6:11] = np.bincount(by_run[s:e], minlength=5)
            part = kinds[s:e]
            counts[k, 11:] = part.count(0), part.count(1), part.count(2)
        pairs = list(zip(words, words[1:]))
        near = sum(len(set(pairs[s : s + REPEAT_WORDS])) for s in range(0, n, REPEAT_WORDS))
        out |= {
            "words": n, "mean_word_length": sum(map(len, words)) / n if n else 0.0, "distinct_share": len(set(words)) / n if n else 0.0,
            "function_share": kinds.count(0) / n if n else 0.0, "known_share": 1 - kinds.count(2) / n if n else 0.0,
            "symbol_share": text.translate(self.classes).count("y") / max(1, len(text)),
            "repeated": n >= STRETCH_WORDS and near < REPEATED * len(pairs),
        }
        return out, counts

    def measure(self, text: str) -> dict:
        return self.measure_all([text])[0]

    def measure_all(self, texts: list[str]) -> list[dict]:
        each = [self._counts(t) for t in texts]
        if not each:
            return []
        of_text = np.repeat(np.arange(len(each)), [len(c) for _, c in each])
        counts = np.concatenate([c for _, c in each])
        first = np.flatnonzero(np.r_[True, of_text[1:] != of_text[:-1]])
        whole = np.add.reduceat(counts, first)[of_text]
        apart = np.zeros((len(counts), len(PROFILES)))

        def shares(columns: slice, mixed: bool) -> np.ndarray:
            own, all_ = counts[:, columns], whole[:, columns]
            if mixed:
                own = own + SHRINK_WORDS * all_ / np.maximum(all_.sum(1, keepdims=True), 1)
            return own / np.maximum(own.sum(1, keepdims=True), 1e-9)

        counts[:, 3] = np.minimum(counts[:, 3], counts[:, [0, 1, 2, 4]].sum(1))  # much white space is layout
        apart += WEIGHTS[0] * _divergence(shares(slice(0, 6), False), CHARACTERS)
        has_words = counts[:, 6:11].sum(1) > 0
        apart += WEIGHTS[1] * has_words[:, None] * _divergence(shares(slice(6, 11), True), RUNS)
        known = whole[:, 11:13].sum(1) / np.maximum(whole[:, 11:].sum(1), 1)
        apart += WEIGHTS[2] * (known * (whole[:, 11:13].sum(1) > 0))[:, None] * _divergence(shares(slice(11, 13), True), np.stack([FUNCTION_SHARE, 1 - FUNCTION_SHARE], 1))
        nearest = apart.argmin(1)
        weight = np.maximum(1, counts[:, [0, 1, 2, 4, 5]].sum(1))
        out = []
        ends = np.r_[first[1:], len(counts)]
        for (said, _), a, b in zip(each, first.tolist(), ends.tolist(), strict=True):
            w = weight[a:b]
            share = np.bincount(nearest[a:b], weights=w, minlength=len(PROFILES)) / w.sum()
            share[PROFILES.index("noise")] = share[PROFILES.index("noise") :].sum()
            share = share[: len(set(PROFILES))]
            removed = said.pop("removed")
            if removed > 0.5:  # what is left of it is less than its markup
                share = share * (1 - removed)
                share[PROFILES.index("markup")] += removed
            prose = 0.0 if said.pop("repeated") else float(share[0])  # the same few words again and again
            rest = int(share[1:].argmax()) + 1
            out.append(said | {"divergence": float((apart[a:b, 0] * w).sum() / w.sum()), "prose_share": prose, "profile": "prose" if prose >= 0.5 else PROFILES[rest]})
        return out


def known_words(rows: DataFrame) -> dict[str, bool]:
    """The words that stand in most records of `rows(id, text)`, and of each whether it is a function word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, listed = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(running.keys() | listed.keys())
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([running[w] for w in words], pa.int64()), pa.array([listed[w] for w in words], pa.int64())], names=["word", "running", "listed"])
            running.clear()
            listed.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found, lengths = _runs(list(_TOKEN.finditer(_bare(text))))
                in_short, in_long = sum(n <= LISTED for n in lengths), sum(n >= RUNNING for n in lengths)
                if 2 * in_long > len(found):
                    running.update({m.group().lower() for m, n in zip(found, lengths, strict=True) if n >= RUNNING})
                elif 2 * in_short > len(found):
                    listed.update({m.group().lower() for m, n in zip(found, lengths, strict=True) if n <= LISTED})
            if len(running) + len(listed) > LOCAL_WORDS:
                yield flush()
        if running or listed:
            yield flush()

    texts = rows.select("text").where("text is not null")
    counted = texts.mapInArrow(count, "word string, running bigint, listed bigint").groupBy("word").agg(F.sum("running").alias("running"), F.sum("listed").alias("listed"))
    both = F.col("running") + F.col("listed")
    # the totals are those of the known words
    got = counted.where(both >= KNOWN_RECORDS).orderBy(both.desc(), "word").limit(KNOWN_WORDS).toPandas()
    running, listed = got["running"].to_numpy(float), got["listed"].to_numpy(float)
    function = running / max(1.0, running.sum()) >= RATIO * (listed + 1) / (listed.sum() + PRIOR_LISTED)
    sure = function | (listed >= CONTENT_RECORDS)
    return dict(zip(got["word"][sure].tolist(), function[sure].tolist(), strict=True))


SCHEMA = "chars int, lines int, closed_lines double, words int, mean_word_length double, function_share double, known_share double, distinct_share double, symbol_share double, divergence double, prose_share double, profile string"


def text_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "plot") -> DataFrame:
    """A row of statistics and the structural profile for every distinct id and text.

    `id, chars, lines, closed_lines, words, mean_word_length, function_share,
    known_share, distinct_share, symbol_share, divergence, prose_share, profile`;
    the id column is always named `id`. A null text, or one of white space only,
    has the profile `empty`, zero counts and null shares. Every text is
    read whole, twice: the words of all are counted first. Repeated rows give one
    row, null ids are kept, other columns are ignored, and an empty table gives
    no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    shared = rows.sparkSession.sparkContext.broadcast(known_words(rows))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                batch = whole.slice(start, 1_000)
                texts = batch.column(1).to_pylist()
                measured = iter(profiler.measure_all([t for t in texts if t is not None and t.strip()]))
                got = [next(measured) if t is not None and t.strip() else dict.fromkeys(names) | {"chars": len(t or ""), "lines": 0, "words": 0, "profile": "empty"} for t in texts]
                made = pa.RecordBatch.from_pylist(got, schema=_ARROW)
                yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["id", *names])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"id {id_type}, {SCHEMA}").dropDuplicates()


_ARROW = pa.schema([(x.split()[0], {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[x.split()[1]]) for x in SCHEMA.split(", ")])
