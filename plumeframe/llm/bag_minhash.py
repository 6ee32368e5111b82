"""Near-duplicate documents by BagMinHash, banding and exact verification.

A document is the bag (multiset) of its five-word shingles; two documents are linked when the weighted Jaccard
similarity of their bags, sum of minima over sum of maxima, is at least 0.8.

Signature. Every shingle has a Poisson process for each of the discrete weight ranges [0,1), [1,2), [2,4), [4,8) ...
with the rate of the range's length; a point carries a component of the signature and a weight in its range, all from
hashes. A bag owns the points whose weight lies below the shingle's count. A component's minimum is the earliest point
the bag owns, so two bags share it with probability equal to their weighted similarity. Points are made in the order
of time for many documents at once and only up to the time by which all components are likely filled; what is still
open is continued, so the outcome does not depend on that time.

Candidates. 36 bands of 6 components: a pair at 0.8 meets in no band with probability 2e-5.
1. Equal bags are one class; only one document of a class goes on.
2. In each bucket (band value) every class is compared with the smallest one. Links become components.
3. In buckets that still hold several components, the members are packed into blocks of bounded size, a component of
   many members into blocks of its own. Pairs of blocks that hold different components are compared inside a task,
   which returns the components that a link joins, never the pairs. So no pair of different components that meets
   in a bucket is left out, and a group of copies costs one comparison per member, not one per pair.
Verification computes the similarity of whole bags, whose elements are 32-bit hashes.

Cases. Words are runs of letters, digits and underscores in lower case. A text of fewer than five words is one
shingle. Texts without a word (empty too) are equal only to the same text. NULL texts and NULL ids are alone. Rows that
repeat a doc_id are one document with all their texts. An empty table gives no rows. Whole texts count, whatever
their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.llm.common import staged
from plumeframe.llm.components import components

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6
MEMO = 300_000
BATCH_SHINGLES = 500_000
BLOCK_DOCS, BLOCK_ELEMENTS, SLICE = 128, 500_000, 4_096
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)
ONE = np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def bag_of(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        h = np.concatenate([h, np.full(SHINGLE - len(h), GOLDEN)])
    n = len(h) - SHINGLE + 1
    code = h[:n].copy()
    for i in range(1, SHINGLE):
        code = mix64(code * STEP + h[i : i + n])
    return np.unique(code, return_counts=True)


def elements_of(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bag as a set: the k-th copy of a shingle is an element of its own. Set similarity is weighted similarity."""
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort((mix64(np.repeat(shingles, counts) + copy.astype(np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted element sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Signature of each non-empty bag: the times of the earliest owned points, one per component."""
    weight = np.array([counts.sum() for _, counts in bags], np.float64)
    key = np.concatenate([shingles for shingles, _ in bags])
    count = np.concatenate([counts for _, counts in bags])
    owner = np.repeat(np.arange(len(bags)), [len(shingles) for shingles, _ in bags])
    # One process per shingle and weight range that the count reaches.
    low = np.zeros(len(key), np.int64)
    parts, level = [], 0
    while len(key):
        high = 1 << level
        salt = mix64(np.array([level + 1], np.uint64) * GOLDEN)
        parts.append((mix64(key + salt), np.full(len(key), high - low[0], np.float64), low, count, owner))
        more = count > high
        key, count, owner, low = key[more], count[more], owner[more], np.full(more.sum(), high, np.int64)
        level += 1
    state, rate, low, count, owner = (np.concatenate(columns) for columns in zip(*parts))
    time = np.zeros(len(state))
    out = np.full((len(bags), size), np.inf)
    until = size * (math.log(size) + 3) / weight
    while len(state):
        waiting = []
        while len(state):
            state = state + GOLDEN
            draw = mix64(state)
            step = -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
            due = time + step
            now = due <= until[owner]
            if not now.all():
                late = ~now
                waiting.append((state[late] - GOLDEN, rate[late], low[late], count[late], owner[late], time[late]))
                state, rate, low, count, owner, due = (x[now] for x in (state, rate, low, count, owner, due))
            time = due
            place = mix64(state ^ GOLDEN)
            part = ((place >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            at = low + ((place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64)
            owned = at < count
            spot = owner[owned] * size + part[owned].astype(np.int64)
            np.minimum.at(out.reshape(-1), spot, due[owned])
        # Documents with an open component go on for twice the time; the others are done.
        unfilled = np.isinf(out).any(axis=1)
        if not waiting or not unfilled.any():
            break
        until = np.where(unfilled, until * 2, 0.0)
        state, rate, low, count, owner, time = (np.concatenate(columns) for columns in zip(*waiting))
        go = unfilled[owner]
        state, rate, low, count, owner, time = (x[go] for x in (state, rate, low, count, owner, time))
    return out


def band_values(signature: np.ndarray) -> np.ndarray:
    """A 64-bit value per band: documents share it when the band's components are equal."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, ROWS)
    code = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLDEN, bits.shape[:2]).copy()
    for i in range(ROWS):
        code = mix64(code * STEP + bits[:, :, i])
    return code.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def flush(ids: list, bags: list, digests: list) -> pa.RecordBatch:
        bands: list = [[]] * len(bags)
        filled = [i for i, (_, counts) in enumerate(bags) if len(counts)]
        if filled:
            for i, row in zip(filled, band_values(signatures([bags[i] for i in filled], BANDS * ROWS))):
                bands[i] = row
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([int(c.sum()) for _, c in bags], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "digest", "n", "bands"],
        )

    for batch in batches:
        ids, bags, digests, waiting = [], [], [], 0
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            text = text.as_py()
            bag = bag_of(text, hashes)
            content = bag[0].tobytes() + bag[1].tobytes() if len(bag[0]) else b"-" + text.encode()
            ids.append(doc_id)
            bags.append(bag)
            digests.append(blake2b(content, digest_size=16).digest())
            waiting += len(bag[0])
            if waiting >= BATCH_SHINGLES:
                yield flush(ids, bags, digests)
                ids, bags, digests, waiting = [], [], [], 0
        if ids:
            yield flush(ids, bags, digests)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        elements = [elements_of(*bag_of(text, hashes)).tobytes() for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(elements, pa.binary())], names=["doc_id", "bag"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [
            similarity(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32)) >= SIMILARITY
            for a, b in zip(batch["bag_a"], batch["bag_b"])
        ]
        keep = pa.array(near, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each set on the left with each on the right, by products of slices of elements."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint32)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    again = elements[1:] == elements[:-1]
    shared = np.concatenate([again, [False]]) | np.concatenate([[False], again]) if len(elements) else np.empty(0, bool)
    elements, owner = elements[shared], owner[shared]
    column = np.cumsum(np.concatenate([[0], elements[1:] != elements[:-1]])) if len(elements) else np.empty(0, np.int64)
    out = np.zeros((len(left), len(right)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        a, b = np.searchsorted(column, [first, first + SLICE])
        held = np.zeros((len(sets), SLICE), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of components with a link between two blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            roots, sets = [], []
            for name in ("rows", "others"):
                rows = batch[name][i].values
                roots.append(rows.field("root").to_numpy())
                sets.append([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.field("bag")])
            common = overlaps(*sets)
            size = [np.array([len(x) for x in own]) for own in sets]
            near = common >= SIMILARITY * (size[0][:, None] + size[1][None, :] - common) - 1e-9
            a, b = np.nonzero(near & (roots[0][:, None] != roots[1][None, :]))
            pairs = np.unique(np.sort(np.stack([roots[0][a], roots[1][b]], axis=1), axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["a", "b"])


def _joined_components(mixed: DataFrame, bags: DataFrame) -> DataFrame:
    """``a, b``: components of the ``bucket, rep, n, root`` entries that are linked through a pair in a bucket."""
    counts = mixed.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    # A component with many members in a bucket has blocks of its own (``own`` is its root), the others share blocks.
    counts = counts.withColumn("own", F.when(F.col("c") >= BLOCK_DOCS, F.col("root")))
    blocks = F.greatest(F.ceil(F.sum("c") / BLOCK_DOCS), F.ceil(F.sum("w") / BLOCK_ELEMENTS)).alias("blocks")
    own = counts.filter(F.col("own").isNotNull()).groupBy("bucket", "own").agg(blocks)
    rest = counts.filter(F.col("own").isNull()).groupBy("bucket").agg(blocks).withColumn("own", F.lit(-1).cast("long"))
    sizes = own.unionByName(rest)
    sizes = sizes.join(sizes.groupBy("bucket").agg(F.sum("blocks").alias("all_blocks")), "bucket")
    placed = mixed.join(counts.select("bucket", "root", F.coalesce("own", F.lit(-1)).alias("own")), ["bucket", "root"]).join(sizes, ["bucket", "own"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    packs = placed.join(bags.withColumnRenamed("doc_id", "rep"), "rep").groupBy("bucket", "own", "block", "all_blocks")
    packs = staged(packs.agg(F.collect_list(F.struct("rep", "root", "bag")).alias("rows")), "blocks")
    # A shared block is compared with itself where it lies; only blocks of buckets with several blocks move to meet others.
    within = packs.filter(F.col("own") == -1).select("rows", F.col("rows").alias("others"))
    several = packs.filter(F.col("all_blocks") > 1).drop("all_blocks")
    names = several.select("bucket", "own", "block")
    others = names.select("bucket", F.col("own").alias("own_"), F.col("block").alias("block_"))
    # Blocks of one large component need no comparison with each other.
    shared = (F.col("own") == -1) & (F.col("own_") == -1) & (F.col("block") > F.col("block_"))
    pairs = names.join(others, "bucket").filter((F.col("own") > F.col("own_")) | shared)
    right = several.select("bucket", F.col("own").alias("own_"), F.col("block").alias("block_"), F.col("rows").alias("others"))
    across = pairs.join(several, ["bucket", "own", "block"]).join(right, ["bucket", "own_", "block_"]).select("rows", "others")
    met = within.unionByName(across)
    return staged(met.mapInArrow(_joined, "a long, b long").distinct(), "joined")


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs of documents whose bags are similar enough."""
    a, b = (bags.select(F.col("doc_id").alias(x), F.col("bag").alias(f"bag_{x}")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "bag_a", "bag_b")
    return staged(joined.mapInArrow(_verify, "a long, b long"), "verified")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, copies, kept`` for every document: the smallest id of its group, and whether that is it.

    ``copies`` is the number of documents with the same bag, itself included.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = texts.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sketches = staged(usable.mapInArrow(_sketch, "doc_id long, digest binary, n long, bands array<long>"), "sketches")
    classes = staged(sketches.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies")), "classes")
    member = sketches.select("doc_id", "digest").join(classes, "digest")
    same = member.filter(F.col("doc_id") > F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    # One document per class, in the buckets that hold more than one class.
    shown = sketches.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "bands"), "doc_id").alias("one"))
    entries = shown.select("rep", F.col("one.n").alias("n"), F.explode("one.bands").alias("bucket"))
    least = entries.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter(F.col("first") < F.col("last"))
    shared = staged(entries.join(least.select("bucket", "first"), "bucket"), "buckets")
    first = shared.filter(F.col("rep") != F.col("first")).select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    bags = staged(usable.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_bags, "doc_id long, bag binary"), "bags")
    links = _verified(first, bags)

    roots = components(links)
    labelled = shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter(F.col("x") < F.col("y")).select("bucket")
    open_ = staged(labelled.join(mixed, "bucket").filter(F.col("rep") != F.col("first")).select("bucket", "rep", "n", "root"), "open")
    more = _joined_components(open_, bags)

    group = components(same.unionByName(links).unionByName(more)).withColumnRenamed("node", "doc_id")
    sizes = member.groupBy("doc_id").agg(F.max("copies").alias("copies"))
    known = sizes.join(group, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), "copies")
    ids = texts.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().join(known, "doc_id", "left")
    alone = texts.filter(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    whole = ids.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))
    return whole.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: one of each group, all with a NULL id.

    Rows that repeat id and text stay once, in an order that their other columns fix; other texts under the same id stay.
    """
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    ids = docs.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti")
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*[f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"]))
    once = ids.withColumn("_again", F.row_number().over(again)).filter(F.col("_again") == 1)
    return once.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
