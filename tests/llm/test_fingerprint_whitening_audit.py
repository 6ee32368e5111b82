"""Fingerprints, whitening and the filter audit: brute force on small rows, and the cases their docstrings name."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeframe.llm import filter_audit, multiset_fingerprint, whitening
from plumeframe.llm.multiset_fingerprint import Fingerprint
from plumeframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, fingerprint string"
MEGABYTES = "one line of words here.\n" * 60_000 + "x" * 1_000_000


def test_fingerprints_are_multisets_of_paragraphs():
    a, b = Fingerprint.of("one\ntwo\ntwo\n"), Fingerprint.of("\ntwo\none\ntwo")
    assert a == b and a != Fingerprint.of("one\ntwo\n") and a != Fingerprint.of("one\ntwo\ntwo")
    assert Fingerprint.of(None) == Fingerprint.of("")
    assert a - Fingerprint.of("two") + Fingerprint.of("three\nfour") == Fingerprint.of("one\ntwo\n\nthree\nfour")
    assert Fingerprint.read(str(a)) == a
    # Sums of wide vectors, taken one by one.
    total = sum(int.from_bytes(hashlib.shake_128(p).digest(8), "little") for p in (b"one", b"two", b"two", b"")) % 2**64
    assert int(a.lanes[0]) == total


def test_likeness_follows_shared_phrases():
    rng = np.random.default_rng(5)
    words = [" ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(6)) + "." for _ in range(400)]
    whole = Fingerprint.of(" ".join(words[:200]))
    assert whole.likeness(Fingerprint.of(" ".join(words[:100] + words[200:300]))) == pytest.approx(0.5, abs=0.15)
    assert whole.likeness(Fingerprint.of(" ".join(words[200:]))) < 0.15
    assert whole.likeness(whole) == 1.0 and whole.likeness(Fingerprint.of("")) == 0.0 and Fingerprint.of("").likeness(Fingerprint.of("")) == 1.0


def expected(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_chars, sha, fingerprint, edited) by plain recounting."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(Fingerprint.of(text)), str(Fingerprint.of(edited))))
    return sorted(out, key=str)


def judged(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in df.collect()), key=str)


def test_edited_fingerprints_of_hard_rows(spark):
    rows = [(5, "a b c\nd e f. g\n\nh", "x", "old"), (4, None, None, None), (9, "", "y", ""), (2, "é漢字\n" * 7, "z", ""), (None, "last of all\nx", "", ""), (1, MEGABYTES, "", ""), (3, "a b c\nd e f. g\n\nh", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    for size in (1, 1 << 30):
        assert judged(multiset_fingerprint.edited_fingerprints(docs, bucket_bytes=size)) == expected(rows)
    lone = multiset_fingerprint.edited_fingerprints(spark.createDataFrame(rows[:1], DOCS)).first()
    assert lone["near_next"] == 1.0 and 0 <= lone["near_edited"] <= 1
    repeated = [(7, "same\ntext", "", "")] * 5 + [(6, "other", "", "")]
    assert judged(multiset_fingerprint.edited_fingerprints(spark.createDataFrame(repeated, DOCS), bucket_bytes=4)) == expected(repeated)
    assert multiset_fingerprint.edited_fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprint_query_equals_recount(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = QUERIES["op11_multiset_fingerprint"](spark, SF)
    assert judged(found) == expected(rows)
    split = multiset_fingerprint.edited_fingerprints(docs, bucket_bytes=40_000)
    assert judged(split) == expected(rows)
    near = found.agg(F.avg("near_edited"), F.avg("near_next"), F.max("near_edited"), F.min("near_next")).first()
    assert near[0] > 0.35 and near[1] < 0.1 and near[2] <= 1 and near[3] >= 0


def test_fingerprints_follow_edits(spark):
    rows = [(1, "a\nb\nc", "b", "d\ne"), (2, None, None, "x"), (3, "k", "k", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string, inserted string")
    got = {r["doc_id"]: r["fingerprint"] for r in multiset_fingerprint.updated(multiset_fingerprint.fingerprints(docs)).collect()}
    assert got[1] == str(Fingerprint.of("a\nc\nd\ne")) and got[2] == str(Fingerprint.of("\nx")) and Fingerprint.read(got[3]).lanes.sum() == 0
    pairs = spark.createDataFrame([(got[1], got[1]), (got[1], None)], "a string, b string")
    assert [r["likeness"] for r in multiset_fingerprint.likeness(pairs, "a", "b").collect()] == [1.0, None]


def whitened_by_hand(rows, scale=256.0, components=4, counts=False):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    distinct = Counter(tuple(x) for _, x in kept)
    weights = [m if counts else 1 for m in distinct.values()]
    n, fit = sum(weights), np.array(list(distinct), float)
    sums = [sum(w * x[j] for w, x in zip(weights, distinct)) for j in range(fit.shape[1])]
    centred = fit - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh((centred * np.array(weights, float)[:, None]).T @ centred / n)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    out = []
    for i, x in kept:
        place = (np.array(x, float) - np.array([s / n for s in sums])) @ vectors.T / np.sqrt(values)
        out += [(i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), p, e / (centred**2 * np.array(weights)[:, None]).sum() * n) for k, (p, e) in enumerate(zip(place, values))]
    return out


def check_whitened(found, wanted):
    got = sorted(tuple(r[c] for c in ("vec_id", "component", "n", "deviation", "whitened", "explained")) for r in found.collect())
    wanted = sorted(wanted)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    for k in {g[1] for g in got}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, wanted))
        sign = np.sign(a[np.abs(b).argmax()] * b[np.abs(b).argmax()])
        assert np.allclose(a, sign * b, atol=1e-9)
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted], rtol=1e-9)


def test_whitening_query_equals_numpy(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = QUERIES["op12_whitening"](spark, SF)
    check_whitened(found, whitened_by_hand(rows))
    assert found.agg(F.max("identity_error")).first()[0] < 1e-9


VECTORS = "vec_id long, embedding array<double>, label string, X int"


def test_whitening_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)] + [(50 + i % 3, [0.5, -0.25, 1.0]) for i in range(40)]
    rows += [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 1.0]), (93, []), (94, [float("inf"), 0.0, 0.0])]
    docs = spark.createDataFrame([(i, v, "l", 1) for i, v in rows], VECTORS)
    check_whitened(whitening.whiten(docs, rows_per_task=7), whitened_by_hand(rows))
    check_whitened(whitening.whiten(docs, weights="count"), whitened_by_hand(rows, counts=True))
    assert whitening.whiten(docs).filter("component > 3").count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "l", 1), (1, [1.0, 2.0], "l", 1)], VECTORS)).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["identity_error"] is None for r in flat)
    mixed = rows[:5] + [(200, [1.0, 2.0]), (201, [3.0, 4.0]), (202, [0.0, 9.0])]
    both = whitening.whiten(spark.createDataFrame([(i, v, "l", 1) for i, v in mixed], VECTORS))
    assert {(r["vec_id"] >= 200, r["n"]) for r in both.collect()} == {(False, 5), (True, 3)}
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(docs, weights="some")


def test_deviations_stay_exact():
    x = np.array([[3_000_000_000, 1], [-3_000_000_000, 2]])
    assert whitening.deviations(x, 2, (0, 3)) == [None, None]
    assert whitening.deviations(x // 10, 2, (0, 3)) == [600_000_000**2 + 9, 600_000_000**2 + 9]


def audited(docs, labels):
    """The audit by plain counting."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least: dict = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        steps, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for at, letter in enumerate(order, 1):
                lost, left = [r for r in left if letter in r[1]], [r for r in left if letter not in r[1]]
                shapley[letter] += len(lost)
                failing = sum(letter in r[1] for r in mine)
                steps.append((part, "".join(order), at, len(left), len(lost), failing - len(lost), sum(r[1] == {letter} for r in mine), sum(r[2] for r in lost), sum(r[3] for r in lost)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def found_audit(df):
    return sorted(tuple(r) for r in df.collect())


LABELS = "doc_id long, quality int, toxic int, digest string"


def test_audit_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert found_audit(QUERIES["op13_filter_audit"](spark, SF)) == audited(docs, labels)


def test_audit_cases(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [(1, long, "en"), (2, long, None), (2, long, "en"), (2, "AB # ab", ""), (None, long, "en"), (None, long, "en"), (7, None, "de"), (8, "", "de"), (9, "A" * 500, "de")]
    docs += [(10, "tail   mark\x0b" * 100_000, "en"), (11, "漢字" * 1_000_000, "en"), (0, long, "fr")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (10, 1, 1)]
    asked = spark.createDataFrame([(*d, 3, "m") for d in docs], "doc_id long, text string, lang string, mask int, part string")
    marked = spark.createDataFrame([(*x, "m") for x in labels], LABELS)
    assert found_audit(filter_audit.interaction_audit(asked, marked)) == audited(docs, labels)
    assert found_audit(filter_audit.interaction_audit(asked, marked.limit(0))) == audited(docs, [])
    assert filter_audit.interaction_audit(asked.limit(0), marked).count() == 0


def test_diagram_swaps_keep_counts():
    rng = np.random.default_rng(4)
    counts = {m: (int(rng.integers(0, 3)), 0, 0) for m in range(32)}
    diagram = filter_audit.Diagram(counts, 5, 3)
    sizes = set()
    for level in filter_audit.adjacent_swaps(5):
        diagram.swap(level)
        sizes.add(sum(map(len, diagram.nodes)))
        assert diagram.weights()[0][diagram.root][0] == sum(c[0] for c in counts.values())
    assert max(sizes) <= 31 and len(sizes) > 1
