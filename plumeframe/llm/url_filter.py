"""Judging urls by rules kept in a sorted digest array.

The index is one file: the rules' 64-bit xxhash digests in order, then their strings and verdicts. It lies in the
shared folder, Spark hands it to each executor (``addFile``), and every task maps it into memory, so the pages of the
file are shared by the tasks of a machine and nothing is unpacked. A url gives one key per host suffix and rule path
length. The digests of a batch of keys are found together by binary search, and a hit counts only if the stored
string equals the key. The urls never move.

The list of rules reaches every machine, so its size is checked: more than ``MAX_RULES`` rules is an error.

Cases. A NULL url, or one without ``://``, has an empty host and path and fits no rule. The longest fitting rule
(host and path together, in characters; then the longer host) decides. A rule given twice with different verdicts
blocks. A url without a fitting rule is allowed. NULL rules are ignored; without rules all is allowed. Repeated rows
are judged one by one. Input columns named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeframe.llm.common import schema_with, without
from plumeframe.scale import ensure_checkpoint_dir

MAX_RULES = 5_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEADER = 4


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")


def url_host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: str = "url") -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def digest_array(rules: dict[str, str]) -> bytes:
    """The file: count, number of path lengths, path lengths, digests, string ends, host lengths, verdicts, strings."""
    keys = sorted((xxhash.xxh64_intdigest(rule), rule) for rule in rules)
    strings = [rule.encode() for _, rule in keys]
    hosts = [rule.partition("/")[0] for _, rule in keys]
    lengths = sorted({len(rule) - len(host) for (_, rule), host in zip(keys, hosts)})
    parts = (
        np.array([len(keys), len(lengths), 0, 0], np.uint64),
        np.array(lengths, np.uint64),
        np.array([digest for digest, _ in keys], np.uint64),
        np.concatenate([np.zeros(1, np.uint64), np.cumsum([len(s) for s in strings], dtype=np.uint64)]),
        np.array([len(host) for host in hosts], np.uint64),
        np.array([rules[rule] == "block" for _, rule in keys], np.uint64),
    )
    return b"".join([*(p.tobytes() for p in parts), *strings])


class DigestArray:
    """A mapped index file."""

    def __init__(self, path: str):
        numbers = np.memmap(path, np.uint64, mode="r", shape=(HEADER,))
        n, k = int(numbers[0]), int(numbers[1])
        at = 8 * HEADER

        def block(count: int) -> np.ndarray:
            nonlocal at
            here, at = at, at + 8 * count
            return np.memmap(path, np.uint64, mode="r", offset=here, shape=(count,)) if count else np.empty(0, np.uint64)

        self.lengths = block(k).tolist()
        self.digests, self.ends, self.hosts, self.blocks = block(n), block(n + 1), block(n), block(n)
        self.strings = np.memmap(path, np.uint8, mode="r", offset=at) if n else np.empty(0, np.uint8)

    def find(self, keys: list[str]) -> np.ndarray:
        """Number of the rule that equals each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return found
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, digests, "left")
        last = np.searchsorted(self.digests, digests, "right")
        for i in np.flatnonzero(last > first):
            key = keys[i].encode()
            for at in range(first[i], last[i]):  # several rules only where digests collide
                if self.strings[self.ends[at] : self.ends[at + 1]].tobytes() == key:
                    found[i] = at
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        keys, owners = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            labels = host.split(".") if host else []
            for j in range(len(labels)):
                suffix = ".".join(labels[j:])
                for length in self.lengths:
                    if length <= len(path):
                        keys.append(suffix + path[:length])
                        owners.append(i)
        found = self.find(keys)
        best: dict[int, tuple] = {}
        for k in np.flatnonzero(found >= 0):
            rule = (len(keys[k]), int(self.hosts[found[k]]), keys[k], bool(self.blocks[found[k]]))
            best[owners[k]] = max(best.get(owners[k], rule), rule)
        none = (0, 0, None, False)
        chosen = [best.get(i, none) for i in range(len(hosts))]
        return [c[2] for c in chosen], ["block" if c[3] else "allow" for c in chosen]


def write_index(rules: DataFrame) -> str:
    """Write the digest array of ``rules`` (``rule`` like ``example.com/path``, ``verdict``) and hand it to the executors."""
    spark = rules.sparkSession
    ensure_checkpoint_dir(spark)
    known = rules.filter(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    if (n := known.count()) > MAX_RULES:
        raise ValueError(f"{n} rules; an index holds {MAX_RULES} at most")
    content = digest_array({r["rule"]: r["verdict"] for r in known.collect()})
    sc = spark.sparkContext
    name = f"url-rules-{xxhash.xxh128_hexdigest(content)}.bin"
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/llm/{name}")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()
    sc.addFile(target.toString())
    return name


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def judge_urls(pages: DataFrame, index: str) -> DataFrame:
    """The rows of ``pages`` (``url`` and others) with ``host``, ``path``, ``rule`` and ``verdict``."""
    columns = without(pages, ("host", "path", "rule", "verdict"))
    parsed = columns.withColumns({"host": url_host(), "path": url_path()})
    parsed = parsed.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _mapped(index)
        for batch in batches:
            rules, verdicts = array.judge(batch["host"].to_pylist(), batch["path"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return parsed.mapInArrow(run, schema_with(parsed, rule="string", verdict="string"))


def rule_table(spark: SparkSession, block: tuple = (), allow: tuple = ()) -> DataFrame:
    rows = [(r, "block") for r in block] + [(r, "allow") for r in allow]
    return spark.createDataFrame(rows, "rule string, verdict string")
