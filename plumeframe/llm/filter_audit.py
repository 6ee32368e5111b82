"""Audit of how filters interact: what each removes in every order, read off count-weighted decision diagrams.

1. A document becomes a mask of the filters that it fails. Filters of the text alone are bits of the document; the repeat
   filter asks whether a document of smaller id has the same text. Copies are counted per (text, part, labels) before they
   meet, so a text with very many copies is a few rows.
2. Masks are counted by part: at most 32 masks times the labels.
3. Per part the counts become a decision diagram: a level a filter, an edge for passing and one for failing, equal subdiagrams
   stored once, count vectors at the ends. All orders are visited by swaps of adjacent levels. The path of passes
   from the root reads off the steps of an order: the failing edge at a step is what it removes.

Cases. A NULL text is an empty one. Documents that share an id count as rows of their own and are not repeats of each other;
a NULL id is no repeat and makes none. A document is good or toxic if any row of its labels says so; one without labels
is neither. A part appears if it has a document: an empty table gives no rows. Texts compare by length and SHA-256.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What separates words, and the characters of filter D.
SPACES = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TEXT_FILTERS = "ABCD"
REPEAT = "E"
FILTERS = TEXT_FILTERS + REPEAT
LABELS = ("good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failure_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every document; the mask has the filters of the text."""
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    measured = plain.select(
        "doc_id",
        "part",
        F.concat(F.unhex(F.sha2("text", 256)), F.encode(F.length("text").cast("string"), "UTF-8")).alias("digest"),
        F.size(words).cast("long").alias("n"),
        F.size(F.array_distinct(words)).cast("long").alias("distinct"),
        F.length("text").cast("long").alias("chars"),
        F.length(F.translate("text", CAPITALS, "")).cast("long").alias("others"),
        F.col("text").rlike(MARKS).alias("marked"),
    )
    fails = (
        F.col("n") < 100,
        100 * F.col("distinct") < 80 * F.col("n"),
        100 * (F.col("chars") - F.col("others")) > 10 * F.col("chars"),
        F.col("marked"),
    )
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    return measured.select("doc_id", "part", "digest", mask.cast("int").alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, count, good, toxic``: documents of each failure mask, repeats included, and how many of them are labelled."""
    marks = labels.groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    kinds = ["digest", "part", "mask", *LABELS]
    marked = failure_masks(docs).join(marks, "doc_id", "left").fillna(0, list(LABELS))
    rows = marked.groupBy("doc_id", *kinds).agg(F.count("*").alias("c"))
    # Ids are unique within a kind now, so its smallest id has one count.
    known = F.col("doc_id").isNotNull()
    groups = rows.groupBy(*kinds).agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("unnamed"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("c", F.col("doc_id")), F.lit(0)).alias("at_least"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    passing = F.col("unnamed") + F.when(first, F.col("at_least")).otherwise(F.lit(0))
    split = groups.withColumn("passing", passing).select(
        "part", *LABELS,
        F.inline(F.array(
            F.struct("mask", F.col("passing").alias("c")),
            F.struct((F.col("mask") + (1 << len(TEXT_FILTERS))).alias("mask"), (F.col("n") - F.col("passing")).alias("c")),
        )),
    )
    return split.groupBy("part", "mask").agg(F.sum("c").alias("count"), *[F.sum(F.col(m) * F.col("c")).alias(m) for m in LABELS])


class Diagram:
    """Decision diagram over failure masks. A node is (passing child, failing child); an end is a vector of counts.

    ``order[level]`` is the variable of a level. Nodes of a level are unique; every path visits every level.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], variables: int, width: int):
        self.order = list(range(variables))
        self.ends: list[tuple[int, ...]] = []
        self._end: dict[tuple[int, ...], int] = {}
        self._unique: list[dict[tuple[int, int], int]] = [{} for _ in range(variables)]
        self.nodes: list[list[tuple[int, int]]] = [[] for _ in range(variables)]
        self._zero = (0,) * width
        self.root = self._build(counts, 0, 0)

    def _build(self, counts: dict[int, tuple[int, ...]], level: int, mask: int) -> int:
        if level == len(self.order):
            return self._leaf(counts.get(mask, self._zero))
        return self._node(level, self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << level))

    def _leaf(self, value: tuple[int, ...]) -> int:
        if value not in self._end:
            self._end[value] = len(self.ends)
            self.ends.append(value)
        return self._end[value]

    def _node(self, level: int, passing: int, failing: int) -> int:
        known = self._unique[level]
        if (passing, failing) not in known:
            known[passing, failing] = len(self.nodes[level])
            self.nodes[level].append((passing, failing))
        return known[passing, failing]

    def swap(self, level: int) -> None:
        """Exchange a level with the next. Levels above keep their nodes but for the numbers of their children."""
        upper, lower = self.nodes[level], self.nodes[level + 1]
        for at in (level, level + 1):
            self.nodes[at], self._unique[at] = [], {}
        moved = []
        for passing, failing in upper:
            (pp, pf), (fp, ff) = lower[passing], lower[failing]
            moved.append(self._node(level, self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)))
        if level == 0:
            self.root = moved[self.root]
        else:
            above = self.nodes[level - 1]
            self.nodes[level - 1] = [(moved[p], moved[f]) for p, f in above]
            self._unique[level - 1] = {pair: i for i, pair in enumerate(self.nodes[level - 1])}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def weights(self) -> list[list[np.ndarray]]:
        """Counts below each node, by level; the last level are the ends."""
        out = [[np.array(v, object) for v in self.ends]]
        for level in reversed(range(len(self.order))):
            out.insert(0, [out[0][p] + out[0][f] for p, f in self.nodes[level]])
        return out

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Along the path of passes: the variable, what fails there, what passes."""
        weights, at = self.weights(), self.root
        for level, variable in enumerate(self.order):
            passing, failing = self.nodes[level][at]
            yield variable, weights[level + 1][failing], weights[level + 1][passing]
            at = passing


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, so that all n! orders are met once, the first one before any swap."""
    if n < 2:
        return
    inner = list(adjacent_swaps(n - 1))
    down = True
    for turn in range(len(inner) + 1):
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        if turn < len(inner):
            # The last variable rests at an edge; the order of the others makes its next step beside it.
            yield inner[turn] + (1 if down else 0)
        down = not down


def audit_part(counts: dict[int, tuple[int, ...]], letters: Sequence[str] = FILTERS) -> list[tuple]:
    """``(order, step, kept, removed, redundant, unique_fails, losses..., shapley)`` of all orders; counts are (documents, losses...)."""
    n = len(letters)
    diagram = Diagram(counts, n, 1 + len(LABELS))
    fails = [sum(c[0] for mask, c in counts.items() if mask >> i & 1) for i in range(n)]
    unique = [counts.get(1 << i, (0,))[0] for i in range(n)]
    rows, total = [], [0] * n
    for swap in itertools.chain([None], adjacent_swaps(n)):
        if swap is not None:
            diagram.swap(swap)
        name = "".join(letters[i] for i in diagram.order)
        for step, (variable, lost, kept) in enumerate(diagram.steps(), 1):
            total[variable] += int(lost[0])
            rows.append((name, step, int(kept[0]), int(lost[0]), fails[variable] - int(lost[0]), unique[variable], *map(int, lost[1:]), variable))
    return [(*row[:-1], total[row[-1]]) for row in rows]


def _audit(table: pa.Table) -> pa.Table:
    counts = {r["mask"]: (r["count"], *(r[m] for m in LABELS)) for r in table.to_pylist()}
    columns = list(zip(*audit_part(counts), strict=True))
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
    part = pa.array([table["part"][0].as_py()] * len(columns[0]), pa.string())
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.Table.from_arrays([part, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see ``SCHEMA``. ``docs`` has doc_id, text, lang; ``labels`` doc_id, quality, toxic."""
    return mask_counts(docs, labels).groupBy("part").applyInArrow(_audit, SCHEMA)
