"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (the pieces between line breaks). Every paragraph is hashed to a wide vector
and the vectors of a text are summed, each lane modulo a power of two:

* ``LANES`` lanes of 64 bits are the output of SHAKE128 over the paragraph. Their sums are equal for equal multisets,
  whatever the order, and differ otherwise but for a chance that nobody meets.
* ``SIGNS`` lanes of 16 bits get +1 or -1 from the bits of BLAKE2b over each phrase of the paragraph (up to ``WORDS``
  words, not beyond a sentence end). The inner product of two such sums estimates that of the phrase counts, so
  fingerprints alone tell how alike two texts are.

A paragraph is inserted by adding its vector and deleted by subtracting it, so a fingerprint follows an edit that is
given by its removed and inserted paragraphs, and fingerprints of documents add up to that of their union.

Each step is a map over partitions. ``edited_fingerprints`` needs the next document of each one: documents are dealt by
ranges of their ids, one bucket a task, sorted there and streamed; a copy of the first document of the following range ends
each bucket. Only bounds of ranges reach the driver.

Cases. A NULL text is an empty one; the empty text is one empty paragraph. Texts of any length are taken whole, phrases in
blocks. Repeated rows get equal fingerprints. The order of documents is that of falling ids, NULL ids last and by their
text's hash, as are documents of one id; ranges split both. Rows that repeat id and text follow each other and are one
range at least. A lone document is its own next one. An empty table gives no rows. An input column named like an
output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumeframe.llm.common import schema_with, staged, without

LANES = 32
SIGNS = 512
WORDS = 8
BLOCK = 4096
BUCKET_BYTES = 128 << 20
_END = ".!?。！？"
# A word of over 64 characters is cut, so that texts without spaces have phrases too.
_WORD = rf"[^\s{_END}]{{1,64}}+"
PHRASE = re.compile(rf"(?:{_WORD}[ \t]++){{0,{WORDS - 1}}}{_WORD}[{_END}]*+")


def _blocks(items: Iterable[bytes], width: int) -> Iterator[np.ndarray]:
    held: list[bytes] = []
    for item in items:
        held.append(item)
        if len(held) == BLOCK:
            yield np.frombuffer(b"".join(held), np.uint8).reshape(-1, width)
            held = []
    if held:
        yield np.frombuffer(b"".join(held), np.uint8).reshape(-1, width)


class Fingerprint:
    """Sum of the paragraph vectors of a multiset."""

    def __init__(self, lanes: np.ndarray, signs: np.ndarray):
        self.lanes, self.signs = lanes, signs

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        counts = Counter((text or "").split("\n"))
        lanes = np.zeros(LANES, np.uint64)
        times = np.fromiter(counts.values(), np.uint64, len(counts))
        at = 0
        for block in _blocks((hashlib.shake_128(p.encode()).digest(8 * LANES) for p in counts), 8 * LANES):
            lanes += (block.view("<u8") * times[at : at + len(block), None]).sum(axis=0, dtype=np.uint64)
            at += len(block)
        signs = np.zeros(SIGNS, np.int64)
        phrases = (hashlib.blake2b(m.group().encode(), digest_size=SIGNS // 8).digest() for m in PHRASE.finditer(text or ""))
        for block in _blocks(phrases, SIGNS // 8):
            signs += 2 * np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64) - len(block)
        return cls(lanes, signs.astype(np.uint16))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes, self.signs + other.signs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes - other.lanes, self.signs - other.signs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.lanes == other.lanes).all() and (self.signs == other.signs).all())

    __hash__ = None

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the cosine of the phrase counts as estimated from the signed lanes, 0 to 1."""
        if self == other:
            return 1.0
        a, b = self.signs.view(np.int16).astype(np.float64), other.signs.view(np.int16).astype(np.float64)
        size = math.sqrt(float(a @ a) * float(b @ b))
        return min(max(float(a @ b) / size, 0.0), 1.0) if size else 0.0

    def __str__(self) -> str:
        return base64.b64encode(self.lanes.astype("<u8").tobytes() + self.signs.astype("<u2").tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw, "<u8", LANES).astype(np.uint64), np.frombuffer(raw, "<u2", SIGNS, 8 * LANES).astype(np.uint16))


def _mapped(docs: DataFrame, name: str, kind: str, make, *names: str) -> DataFrame:
    """``docs`` with a column made from the values of the named ones."""
    kept = without(docs, [name], [n for n in names if n.lower() == name.lower()])
    schema = schema_with(kept.drop(name), **{name: kind})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(*values) for values in zip(*(batch[n].to_pylist() for n in names), strict=True)]
            columns = [batch[c] for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.string() if kind == "string" else pa.float64())], names=schema.names)

    return kept.mapInArrow(rows, schema)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the ``fingerprint`` of each text."""
    return _mapped(docs, "fingerprint", "string", lambda value: str(Fingerprint.of(value)), text)


def updated(docs: DataFrame, removed: str = "removed", inserted: str = "inserted") -> DataFrame:
    """``docs`` with each ``fingerprint`` after deleting the paragraphs of one column and inserting those of another (NULL: none)."""

    def change(print_: str, out: str | None, in_: str | None) -> str:
        now = Fingerprint.read(print_)
        now = now if out is None else now - Fingerprint.of(out)
        return str(now if in_ is None else now + Fingerprint.of(in_))

    return _mapped(docs, "fingerprint", "string", change, "fingerprint", removed, inserted)


def likeness(pairs: DataFrame, one: str, other: str, name: str = "likeness") -> DataFrame:
    """``pairs`` with how alike the texts of two fingerprint columns are (NULL where one is NULL)."""
    alike = lambda a, b: None if a is None or b is None else Fingerprint.read(a).likeness(Fingerprint.read(b))
    return _mapped(pairs, name, "double", alike, one, other)


def tail_replaced(text: str, following: str) -> tuple[str, str, str]:
    """The text with its last half replaced by the start of another, the paragraphs this removes and those it inserts."""
    half = len(text) // 2
    keep, added = len(text) - half, following[:half]
    start = text.rfind("\n", 0, keep) + 1
    return text[:keep] + added, text[start:], text[start:keep] + added


def _with_next(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket in order; each is judged when the row after it is known."""
    held = None
    for batch in batches:
        out: dict[str, list] = {name: [] for name in schema.names}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            text = text or ""
            now = Fingerprint.of(text)
            if held is not None:
                before, own, text_before = held
                edited, removed, inserted = tail_replaced(text_before, text)
                after = own - Fingerprint.of(removed) + Fingerprint.of(inserted)
                digest = hashlib.sha256(edited.encode()).hexdigest()
                row = (before, len(text_before), digest, str(own), str(after), own.likeness(after), own.likeness(now))
                for name, value in zip(schema.names, row, strict=True):
                    out[name].append(value)
            held = doc_id, now, text
        yield pa.RecordBatch.from_pydict(out, schema)


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents with ``_hash`` of the text, which orders those of one id."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))


def _bucketed(rows: DataFrame, floor: int, bounds: list[float]) -> DataFrame:
    """Adds ``_place``, which falls along the order of the documents, and the ``_bucket`` of that place."""
    share = F.col("_hash").cast("double") / float(1 << 64) + 0.5
    placed = rows.withColumn("_place", F.coalesce(F.col("doc_id"), F.lit(floor - 1)).cast("double") - share)
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_place", outputCol="_cut")
    return cut.transform(placed).withColumn("_bucket", F.col("_cut").cast("int")).drop("_cut")


def edited_fingerprints(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprints of all texts and of their edited texts: the last half replaced by the start of the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The edited
    fingerprint comes from the text's own by deleting and inserting paragraphs. ``doc_id`` is a number.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = _ordered(docs)
    narrow = staged(rows.select("doc_id", "_hash", F.octet_length("text").alias("_bytes")), "ids")
    count, volume, floor = narrow.agg(F.count("*"), F.sum("_bytes"), F.min("doc_id")).first()
    floor = int(floor or 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(count, max(math.ceil((volume or 0) / bucket_bytes), min(parts, count // 64))))
    wanted = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = _bucketed(narrow, floor, [0.0]).approxQuantile("_place", wanted, 1 / (8 * buckets)) if count else []
    bounds = sorted(set(cuts)) or [0.0]

    # The first document of each bucket also ends the bucket that lies before it in the order.
    tops = _bucketed(narrow, floor, bounds).groupBy("_bucket").agg(F.max("_place").alias("_place"))
    along = Window.orderBy(F.desc("_bucket"))
    ends = F.coalesce(F.lag("_bucket").over(along), F.last("_bucket").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = staged(tops.select("_bucket", "_place", ends.alias("_ends")), "tops")
    placed = _bucketed(rows, floor, bounds)
    first = Window.partitionBy("_ends").orderBy(F.desc_nulls_last("doc_id"), "_hash")
    heads = placed.join(tops, ["_bucket", "_place"]).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    columns = ("doc_id", "text", "_hash", "_bucket", "_head")
    both = placed.withColumn("_head", F.lit(False)).select(*columns).unionByName(
        heads.withColumn("_bucket", F.col("_ends")).withColumn("_head", F.lit(True)).select(*columns)
    )
    ranged = both.repartitionById(len(bounds) + 1, "_bucket").sortWithinPartitions("_head", F.desc_nulls_last("doc_id"), "_hash")
    schema = schema_with(
        spark.createDataFrame([], f"doc_id {kind.simpleString()}"),
        n_chars="long", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double",
    )
    arrow = to_arrow_schema(schema)
    return ranged.select("doc_id", "text").mapInArrow(lambda batches: _with_next(batches, arrow), schema)
