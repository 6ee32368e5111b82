"""Language identification by words first, then by ever shorter character n-grams.

Training keeps, per language, the most frequent words and the most frequent character n-grams of
each length, from labelled rows. A known word is scored by its log frequency in each language. An
unseen word is scored by its n-grams of the longest length at which any of them is known, down to
single characters; their mean stands for the word. A text's score in a language is the sum over its
words; ``score`` is the softmax of the mean per word, so it does not saturate with length.

Cases. NULL text and text without a letter: ``und`` with score 0. Words of which not even a
character is known say nothing; a text of only such words gets the most frequent language with a
score of one share. Ties go to the more frequent language, then to the smaller name. Without any
labelled row every text is ``und``. Whole texts count, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.llm.common import schema_with, staged, without
from plumeframe.scale import top_rows

UNDECIDED = "und"
WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 5
MEMO = 200_000
LONG_TEXT = 1_000_000


def words_of(text: str) -> Iterator[list[str]]:
    """The lower-case words, a bounded number at a time."""
    lower = text.lower()
    if len(lower) <= LONG_TEXT:
        yield WORD.findall(lower)
        return
    words = (m.group() for m in WORD.finditer(lower))
    while chunk := list(islice(words, LONG_TEXT // 10)):
        yield chunk


def grams(word: str, size: int) -> list[str]:
    """The n-grams of a word with its edges marked; single characters come without the marks."""
    if size == 1:
        return list(word)
    padded = f"<{word}>"
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


@dataclass
class LanguageModel:
    """Log frequencies per language, bounded by the training parameters."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]] = field(default_factory=list)

    def word_scores(self, word: str) -> np.ndarray | None:
        """Log frequency in each language, by the longest known unit; None if nothing is known."""
        known = self.words.get(word)
        if known is not None:
            return known
        for size in range(LONGEST_GRAM, 0, -1):
            units = self.grams[size - 1]
            found = [units[g] for g in grams(word, size) if g in units]
            if found:
                return sum(found[1:], found[0]) / len(found)
        return None


class Reader(dict):
    """Rows of a score table by word: scores per language, then whether it has a letter and whether it counts.

    Words are scored when first met; the table is emptied when it is full.
    """

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.rows = np.zeros((MEMO, len(model.languages) + 2))

    def __missing__(self, word: str) -> int:
        at, row = len(self), self.rows[len(self)]
        row[:] = 0.0
        if any(c.isalpha() for c in word):
            row[-2] = 1.0
            scores = self.model.word_scores(word)
            if scores is not None:
                row[:-2], row[-1] = scores, 1.0
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.model.languages:
            return UNDECIDED, 0.0
        total = np.zeros(self.rows.shape[1])
        for words in words_of(text):
            for i in range(0, len(words), MEMO // 4):
                part = words[i : i + MEMO // 4]
                if len(self) + len(part) > MEMO:
                    self.clear()
                total += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
        if not total[-2]:
            return UNDECIDED, 0.0
        mean = total[:-2] / max(total[-1], 1.0)
        best = int(np.argmax(mean))
        return self.model.languages[best], float(1.0 / np.exp(mean - mean[best]).sum())


def _log_frequencies(rows: list, order: dict[str, int], totals: np.ndarray) -> dict[str, np.ndarray]:
    """Smoothed log frequencies of the units in rows of (lang, unit, n)."""
    counts: dict[str, np.ndarray] = {}
    for lang, unit, n in rows:
        counts.setdefault(unit, np.zeros(len(order)))[order[lang]] = n
    floor = np.log(totals + len(counts) + 1)
    return {unit: np.log(c + 0.5) - floor for unit, c in counts.items()}


def train(
    docs: DataFrame,
    use: Column,
    rows_per_language: int = 1_500,
    words_per_language: int = 20_000,
    grams_per_language: int = 5_000,
) -> LanguageModel:
    """Fit on the rows of ``docs`` (``text``, ``lang``) where ``use`` holds and both are not NULL.

    The classifier is fitted on a bounded sample: of every label the ``rows_per_language`` distinct texts with the smallest
    hashes, all of them where there are fewer; copies of a text count once. The model keeps the
    ``words_per_language`` most frequent words and, for each n-gram length, the
    ``grams_per_language`` most frequent n-grams of each language; only those reach the driver.
    """
    labelled = docs.filter(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    hashed = labelled.withColumn("hash", F.xxhash64("text", "lang"))
    first = staged(top_rows(hashed.select("lang", "hash").distinct(), ["lang"], [F.col("hash")], rows_per_language), "drawn")
    names = [r["lang"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not names:
        return LanguageModel([], {}, [{} for _ in range(LONGEST_GRAM)])
    order = {lang: i for i, lang in enumerate(names)}
    drawn = hashed.join(first, ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"]).select("lang", "text")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: Counter = Counter()
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                for words in words_of(text):
                    for word, n in Counter(words).items():
                        counted[lang, word] += n
            rows = [(lang, 0, word, n) for (lang, word), n in counted.items()]
            by_gram: Counter = Counter()
            for (lang, word), n in counted.items():
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in grams(word, size):
                        by_gram[lang, size, gram] += n
            rows += [(*key, n) for key, n in by_gram.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "size", "unit", "n"])

    counted = drawn.mapInArrow(units, "lang string, size long, unit string, n long").groupBy("lang", "size", "unit").agg(F.sum("n").alias("n"))
    window = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "unit")
    bound = F.when(F.col("size") == 0, words_per_language).otherwise(grams_per_language)
    kept = (
        counted.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= max(words_per_language, grams_per_language))
        .filter(F.col("rank") <= bound)
        .select("lang", "size", "unit", "n")
        .collect()
    )
    by_size: list[list] = [[] for _ in range(LONGEST_GRAM + 1)]
    totals = np.zeros((LONGEST_GRAM + 1, len(names)))
    for lang, size, unit, n in kept:
        by_size[size].append((lang, unit, n))
        totals[size, order[lang]] += n
    tables = [_log_frequencies(rows, order, totals[size]) for size, rows in enumerate(by_size)]
    return LanguageModel(names, tables[0], tables[1:])


def identify(docs: DataFrame, model: LanguageModel, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language of ``text`` and its score; an input column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, (pred, score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            found = [reader.predict(text) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, pred, score],
            )

    return kept.mapInArrow(run, schema_with(kept, **{pred: "string", score: "double"}))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that training never sees; a NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> LanguageModel:
    return train(docs, ~held_out())
