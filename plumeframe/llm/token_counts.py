"""Token counts that survive edits: a segment tree per document over stretches of whole pre-tokens.

A document is cut into leaves of about ``LEAF`` characters, only where a space follows a non-space. No pre-token of
the pattern below crosses such a place and its lookaheads never look back over it, so the tokens of the text are the
tokens of its leaves. The tree keeps characters and tokens per subtree. An edit finds its leaves by descending the
tree, re-encodes them together with one neighbour on each side (an edit can join or part the words at a leaf's edge),
and updates the sums on the way up; the tokens of all other leaves stay as they are.

Documents stay where they are: building and editing are maps over partitions.

Cases. NULL and empty texts have an empty tree and 0 tokens; an edit of a NULL text is ignored, one of an empty text
inserts. Positions and lengths beyond the text are cut to it; NULL inserts are empty; a NULL list is no edit. Edits of
a document apply in their order, each to the outcome of the one before. Texts of any length are counted whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from plumeframe.llm.common import schema_with, without

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of the vocabulary's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 512
SAFE = re.compile(r"(?<=\S)\s")
EDITS = "array<struct<start: long, removed: long, inserted: string>>"


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def leaves_of(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        cut = SAFE.search(text, at + LEAF)
        stop = cut.start() if cut else len(text)
        out.append(text[at:stop])
        at = stop
    return out


class CountTree:
    """Characters and tokens of the leaves, and their sums: node 1 is the root, node n has the children 2n and 2n+1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.base = 1
        while self.base < self.leaves:
            self.base *= 2
        self.chars, self.tokens = ([0] * self.base + leaf + [0] * (self.base - self.leaves) for leaf in (list(chars), list(tokens)))
        for node in range(self.base - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, position: int) -> int:
        """The leaf that holds a character position; the last one beyond the end."""
        if position >= self.chars[1]:
            return self.leaves - 1
        node = 1
        while node < self.base:
            node *= 2
            if position >= self.chars[node]:
                position -= self.chars[node]
                node += 1
        return node - self.base

    def start_of(self, leaf: int) -> int:
        """Characters before a leaf."""
        node, before = leaf + self.base, 0
        while node > 1:
            if node % 2:
                before += self.chars[node - 1]
            node //= 2
        return before

    def replaced(self, first: int, last: int, chars: list[int], tokens: list[int]) -> CountTree:
        """Put new leaves in the place of first..last; only sums above them change if their number stays."""
        if len(chars) != last - first + 1:
            have = slice(self.base, self.base + self.leaves)
            old_chars, old_tokens = self.chars[have], self.tokens[have]
            old_chars[first : last + 1], old_tokens[first : last + 1] = chars, tokens
            return CountTree(old_chars, old_tokens)
        low, high = first + self.base, last + self.base
        self.chars[low : high + 1], self.tokens[low : high + 1] = chars, tokens
        while low > 1:
            low, high = low // 2, high // 2
            for node in range(low, high + 1):
                self._sum(node)
        return self


def build(text: str, coder: tiktoken.Encoding) -> CountTree:
    leaves = leaves_of(text)
    return CountTree([len(x) for x in leaves], [len(coder.encode_ordinary(x)) for x in leaves])


def edit(text: str, tree: CountTree, start: int, removed: int, inserted: str, coder: tiktoken.Encoding) -> tuple[str, CountTree, int]:
    """The text and tree after one edit, and how many characters were encoded for it."""
    start = min(max(start, 0), len(text))
    stop = min(start + max(removed, 0), len(text))
    after = text[:start] + inserted + text[stop:]
    if not tree.leaves:
        return after, build(after, coder), len(after)
    first = max(tree.leaf_at(start) - 1, 0)
    last = min(tree.leaf_at(stop) + 1, tree.leaves - 1)
    begin = tree.start_of(first)
    end = tree.start_of(last) + tree.chars[last + tree.base] + len(after) - len(text)
    parts = leaves_of(after[begin:end])
    tree = tree.replaced(first, last, [len(x) for x in parts], [len(coder.encode_ordinary(x)) for x in parts])
    return after, tree, end - begin


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` (``text`` and others) with ``leaf_chars`` and ``leaf_tokens``: the state to keep, and the count ``n_tokens``."""
    columns = without(docs, ("leaf_chars", "leaf_tokens", "n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            leaves = [leaves_of(text or "") for text in batch["text"].to_pylist()]
            counts = [[len(coder.encode_ordinary(x)) for x in own] for own in leaves]
            added = [
                pa.array([[len(x) for x in own] for own in leaves], pa.list_(pa.int32())),
                pa.array(counts, pa.list_(pa.int32())),
                pa.array([sum(c) for c in counts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "leaf_chars", "leaf_tokens", "n_tokens"])

    return columns.mapInArrow(run, schema_with(columns, leaf_chars="array<int>", leaf_tokens="array<int>", n_tokens="long"))


def apply_edits(counted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Apply the list ``edits`` (``EDITS``) of each row of ``build_trees``; text, state and count are those after it.

    Adds ``n_encoded``, the characters that were encoded again.
    """
    columns = without(counted, ("n_encoded",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            new: dict[str, list] = {"text": [], "leaf_chars": [], "leaf_tokens": [], "n_tokens": [], "n_encoded": []}
            for text, chars, tokens, edits in zip(*(batch[c].to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits"))):
                tree, encoded = CountTree(chars, tokens), 0
                for change in (edits or []) if text is not None else []:
                    text, tree, n = edit(text, tree, change["start"] or 0, change["removed"] or 0, change["inserted"] or "", coder)
                    encoded += n
                have = slice(tree.base, tree.base + tree.leaves)
                for name, value in zip(new, (text, tree.chars[have], tree.tokens[have], tree.total(), encoded)):
                    new[name].append(value)
            kinds = {"text": pa.string(), "leaf_chars": pa.list_(pa.int32()), "leaf_tokens": pa.list_(pa.int32())}
            arrays = {name: pa.array(values, kinds.get(name, pa.int64())) for name, values in new.items()}
            kept = {name: arrays.pop(name, column) for name, column in zip(batch.schema.names, batch.columns)}
            yield pa.RecordBatch.from_arrays([*kept.values(), *arrays.values()], names=[*kept, *arrays])

    return columns.mapInArrow(run, schema_with(columns, n_encoded="long"))
