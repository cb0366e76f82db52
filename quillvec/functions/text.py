"""Tokenisation and text expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .porter import stem

# The English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_words(text: str | Column) -> Column:
    """Lower-cased pieces between characters that are no letter, digit or underscore; only pieces of a-z and 0-9 stay, whole. Null gives []."""
    pieces = F.split(F.lower(_col(text)), r"[^\p{L}\p{N}_]+")
    return F.coalesce(F.filter(pieces, lambda t: t.rlike("^[a-z0-9]+$")), F.array().cast("array<string>"))


def without_stop_words(tokens: str | Column) -> Column:
    return F.filter(_col(tokens), lambda t: ~t.isin(STOP_WORDS))


_L = r"[\p{L}\p{N}]"
_END = r"(?![\p{L}\p{N}_])"
#: Words with their hyphens up to a clitic, clitics, what comes before n't, n't, other words, other characters.
_WORD_TOKENS = (
    rf"{_L}+(?:-{_L}+)*(?='(?:s|m|d|ll|re|ve){_END})|'(?:s|m|d|ll|re|ve){_END}|{_L}+?(?=n't{_END})|n't{_END}|{_L}+(?:-{_L}+)*|[^\s\p{{Z}}]"
)


def word_tokens(text: str | Column) -> Column:
    """Words as a word tokenizer gives them: contractions fall apart (do + n't), hyphenated words stay whole; only tokens of a-z and 0-9 stay."""
    tokens = F.regexp_extract_all(F.lower(_col(text)), F.lit(_WORD_TOKENS), F.lit(0))
    return F.coalesce(F.filter(tokens, lambda t: t.rlike("^[a-z0-9]+$")), F.array().cast("array<string>"))


def concat_with_nulls(*columns: str | Column) -> Column:
    """The columns with blanks between them; a null reads `nan`."""
    return F.concat_ws(" ", *[F.coalesce(_col(c).cast("string"), F.lit("nan")) for c in columns])


def preview(text: str | Column, n: int = 150) -> Column:
    return F.when(F.length(_col(text)) > n, F.concat(F.substring(_col(text), 1, n), F.lit("..."))).otherwise(_col(text))


def matches(text: str | Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case; false for null."""
    return F.coalesce(_col(text).rlike("(?i)" + pattern), F.lit(False))


class _Stems(dict):
    """Word to stem, emptied beyond a number of words so that memory stays bounded."""

    def __missing__(self, word: str) -> str:
        if len(self) >= 500_000:
            self.clear()
        self[word] = s = stem(word)
        return s


def stem_tokens(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """`id, tokens` with every token stemmed, row by row without a shuffle; a task stems each distinct word of a batch once. Null gives []."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Stems()
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            stems = pa.array([None if w is None else known[w] for w in coded.dictionary.to_pylist()], pa.string())
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, stems.take(coded.indices))], names=[id_col, "tokens"])

    rows = df.select(id_col, F.col(tokens_col).alias("tokens"))
    return rows.mapInArrow(run, rows.schema)


def tokenize(df: DataFrame, id_col: str, text: Column, remove_stop_words: bool = True, stemming: bool = True) -> DataFrame:
    """`id, tokens`: split, without stop words, stemmed. A null or empty text gives []."""
    tokens = split_words(text)
    out = df.select(F.col(id_col), (without_stop_words(tokens) if remove_stop_words else tokens).alias("tokens"))
    return stem_tokens(out, id_col, "tokens") if stemming else out
