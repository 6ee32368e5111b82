"""The ten operators on small rows: brute force, round trips, and the cases their docstrings name."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plumeframe.llm import (
    bag_minhash, components, embedding_dedup, language_id, mixing, piece_lattice, pivot_search, sharding, token_counts, url_filter, warc_fixity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_components_of_a_chain_and_of_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3)]
    got = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id(spark):
    texts = {"en": "the cat and the dog were with us then", "de": "der hund und die katze waren nicht bei uns"}
    rows = [(i, texts[k], k, "s", 1) for i in range(20) for k in ("en", "de")]
    model = language_id.train(spark.createDataFrame(rows, DOCS), F.lit(True))
    asked = [(1, "The DOG and the cat", "x"), (2, None, "x"), (3, "12 !!", "x"), (4, "", "x"), (5, "und katzen", "x"), (6, "漢字", "x"), (1, "the dog", "x")]
    found = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string, score string"), model)
    got = [(r["doc_id"], r["lang_pred"]) for r in found.collect()]
    assert got[:5] == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de")] and got[6] == (1, "en")
    scores = [r["score"] for r in found.collect()]
    assert scores[5] == pytest.approx(0.5) and scores[1] == 0.0 and all(0 <= s <= 1 for s in scores)
    none = language_id.train(spark.createDataFrame([], DOCS), F.lit(True))
    assert language_id.identify(spark.createDataFrame(asked, "doc_id long, text string, score string"), none).filter("lang_pred <> 'und'").count() == 0


def test_every_label_is_learnt_from_distinct_texts(spark):
    """A label of one repeated text, labels beyond any count, and a bound that copies do not use up."""
    rows = [(i, "repeated words of one label", "once", "s", 1) for i in range(300)]
    rows += [(1000 + i, f"w{chr(97 + i // 26)}{chr(97 + i % 26)}q common", f"l{i:03d}", "s", 1) for i in range(280)]
    rows += [(2000 + i, "same text again" if i % 2 else f"many {chr(97 + i % 26)}x{chr(97 + i // 26)}", "many", "s", 1) for i in range(400)]
    model = language_id.train(spark.createDataFrame(rows, DOCS), F.lit(True), rows_per_language=50)
    assert len(model.languages) == 282
    asked = [(1, "repeated words of one label", None), (2, "waaq common", None), (3, "wbbq", None)]
    found = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string, score string"), model).collect()
    assert [r["lang_pred"] for r in found] == ["once", "l000", "l027"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.identify(docs, language_id.fit_documents(docs)).filter(language_id.held_out())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_url_rules(spark):
    rules = url_filter.rule_table(spark, ("com/en/", "example.net/de/8", "org/"), ("example.com/en/7", "net/de/"))
    index = url_filter.write_index(rules)
    urls = ["http://A.example.COM/en/77?x", "https://b.com/en/1", "http://example.net/de/81", "http://x.net/de/9", "http://xcom/en/", "nothing", None, "http://o.org/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, Rule string")
    got = rows_of(url_filter.judge_urls(pages, index), "page_id", "host", "path", "rule", "verdict")
    assert [(g[3], g[4]) for g in got] == [
        ("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "allow"), (None, "allow"),
        (None, "allow"), ("org/", "block"),
    ]
    assert got[0][1:3] == ("a.example.com", "/en/77") and got[6][1:3] == ("", "")


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda key: 7)
    (tmp_path / "index").write_bytes(url_filter.digest_array({"a.com/": "block", "b.com/": "allow"}))
    array = url_filter.DigestArray(str(tmp_path / "index"))
    assert array.judge(["a.com", "b.com", "c.com"], ["/", "/x", "/"]) == (["a.com/", "b.com/", None], ["block", "allow", "allow"])


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(1, 1 << 62, 50).astype(np.uint64))
    a, b = rng.integers(1, 9, 50), rng.integers(1, 9, 50)
    s = bag_minhash.signatures([(keys, a), (keys, b)], 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)
    alone = bag_minhash.signatures([(keys, a)], 64)
    assert (alone == bag_minhash.signatures([(keys[:1], a[:1]), (keys, a)], 64)[1:]).all()


def brute_groups(texts):
    bags = {}
    for i, text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        words += [""] * (5 - len(words)) if words else []
        bags[i] = Counter(zip(*[words[k:] for k in range(5)])) if words else Counter({("raw", text): 1}) if text is not None else Counter()
    root = {i: i for i in bags}
    for a, b in itertools.combinations(sorted(bags), 2):
        union = sum((bags[a] | bags[b]).values())
        if union and sum((bags[a] & bags[b]).values()) / union >= 0.8:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(4)]
    texts = []
    for k, text in enumerate(base * 12):
        parts = text.split()
        for _ in range(k // 8):
            parts[rng.integers(len(parts))] = f"n{rng.integers(10_000)}"
        texts.append(" ".join(parts))
    texts += [base[0], base[0].upper(), "", "", None, None, "a b", "A  b", "!!", "!!", "?"]
    rows = list(enumerate(texts))
    found = bag_minhash.near_duplicates(spark.createDataFrame(rows + [(0, texts[0])], "doc_id long, text string"))
    assert dict(rows_of(found, "doc_id", "class_id")) == brute_groups(rows)
    none = spark.createDataFrame([(None, "x y"), (None, None)], "doc_id long, text string")
    assert rows_of(bag_minhash.near_duplicates(none), "doc_id", "class_id", "kept") == [(None, None, True)] * 2
    assert bag_minhash.near_duplicates(none.limit(0)).count() == 0
    kept = bag_minhash.keep_one(spark.createDataFrame([*rows, (0, texts[0]), (None, "z")], "doc_id long, text string"))
    assert kept.count() == len(set(brute_groups(rows).values())) + 1
    twice = [(1, base[0], "a"), (1, base[0], "b"), (1, base[1], "c"), (2, base[2], "d")]
    left = [rows_of(bag_minhash.keep_one(spark.createDataFrame(r, "doc_id long, text string, source string")), "doc_id", "text") for r in (twice, twice[::-1])]
    assert left[0] == left[1] == sorted([(1, base[0]), (1, base[1]), (2, base[2])], key=str)


def test_overlaps_count_common_elements():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9_000, n).astype(np.uint32)) for n in (0, 5, 300, 6_000, 6_000)]
    got = bag_minhash.overlaps(sets[:3], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)], 0) for i in range(250)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [1.0, None], 0), (303, [float("nan")] * 8, 0), (400, [1.0, 2.0], 0), (401, [0.0, 1.0], 0), rows[7], (None, [1.0] * 8, 0)]
    index = pivot_search.pivot_table(spark.createDataFrame(rows, VECTORS), pivots=4)
    got = rows_of(pivot_search.top_k(index, F.col("vec_id") % 100 == 0, k=10, query_rows=2, pack_rows=40), "query_id", "rank", "vec_id", "score")
    good = {i: np.floor(1024 * np.array(np.float32(v), dtype=np.float64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 100 == 0):
        best = sorted((-int(good[q] @ c), i) for i, c in good.items() if i != q and len(c) == len(good[q]))[:10]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want, key=str)


def test_a_pack_gives_its_best_rows_whatever_the_blocks():
    rng = np.random.default_rng(4)
    for scale in (1, 1 << 29):
        vectors = rng.integers(-3, 4, size=(90, 6)) * scale
        pivots = pivot_search.choose_pivots(vectors.astype(float), 3)
        away = np.stack([np.linalg.norm(vectors - p, axis=1) for p in pivots], axis=1)
        ids = rng.permutation(90).astype(np.int64)
        query, floors = (ids[:7], vectors[:7], away[:7]), np.full(7, -np.inf)
        rows, found, scores = pivot_search.best_of_pack(query, (ids, vectors, away), 5, floors, block_rows=8)
        for i in range(7):
            best = sorted((-int(s), int(j)) for s, j in zip(vectors @ vectors[i], ids) if j != ids[i])[:5]
            assert sorted((-int(s), int(j)) for s, j in zip(scores[rows == i], found[rows == i])) == best
            assert floors[i] == -best[-1][0]


def test_a_search_of_few_queries_is_spread_over_tasks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(1000)]
    index = pivot_search.pivot_table(spark.createDataFrame(rows, VECTORS), pivots=4)
    found = pivot_search.top_k(index, F.col("vec_id") % 100 == 0, k=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "FlatMapCoGroupsInArrow" in plan
    lanes = pivot_search._lanes(index, F.col("vec_id") % 100 == 0, 4_096).first()
    assert lanes["lanes"] * lanes["sides"] > 1 and found.count() == 30


def test_fixity_audit_finds_damage_and_loss(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>" + "x" * (i * 37 % 900)) for i in range(300)] + [(None, None, None), (5, "http://h/5", "<p>" + "x" * 185)], "page_id long, url string, html string")
    records = warc_fixity.warc_records(pages, file_bytes=40_000)
    warc_fixity.write_warc(pages, str(tmp_path / "archive"), file_bytes=40_000)
    columns = ("warc_file", "record_offset", "record_length", "record_digest")
    assert rows_of(warc_fixity.read_warc(spark, str(tmp_path / "archive")), *columns) == rows_of(records, *columns)
    shape = warc_fixity.tree_shape(records)
    tree = warc_fixity.fixity_tree(records, shape)
    assert warc_fixity.audit(tree, warc_fixity.fixity_tree(records, shape), shape).count() == 0
    bad = records.filter("page_id is null or page_id <> 17").withColumn("record_digest", F.when(F.col("page_id") == 40, "0").otherwise(F.col("record_digest")))
    faults = warc_fixity.audit(tree, warc_fixity.fixity_tree(bad, shape), shape)
    found = faults.join(records, ["warc_file", "record_offset"])
    assert rows_of(found, "page_id", "status") == [(17, "missing"), (40, "corrupt")]


def test_lattice_fold_equals_the_recurrence_and_decodes(spark):
    pieces = piece_lattice.load_pieces()
    library = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.MODEL)
    texts = ["Hello  world\nfoo  ", "", None, "a▁b ▁ c", "日本 ẞ𝄞\x00x", "=" * 300 + " " + "abcd" * 40, " ", "the_name a_{b} ².5", "▁", "Hello  world\nfoo  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("IDS", F.lit(1))
    encoded = piece_lattice.encode(docs, pieces)
    got = {r["doc_id"]: r for r in piece_lattice.decode(encoded, pieces).collect()}
    assert {i: got[i]["text"] for i in got} == dict(enumerate(texts)) and all(r["round_trip"] for r in got.values())
    for i, text in enumerate(texts):
        if text and "▁" not in text:
            whole = piece_lattice.viterbi((" " + text).replace(" ", "▁"), pieces)
            assert list(got[i]["ids"]) == whole and library.decode(whole) == text
    assert piece_lattice.encode(docs.limit(0), pieces).count() == 0


def test_counts_after_edits_equal_a_recount(spark):
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("ab ,.\n  é1'"), 4_000))
    edits = [(int(rng.integers(0, 4_200)), int(rng.integers(0, 60)), "".join(rng.choice(list("xy z\n"), rng.integers(0, 9)))) for _ in range(60)]
    rows = [(1, text, edits), (2, "", [(0, 0, "new text")]), (3, None, [(0, 0, "x")]), (4, "same", None), (5, "gone", [(0, 9, None)])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    after = {r["doc_id"]: r for r in token_counts.apply_edits(token_counts.build_trees(docs)).collect()}
    coder = token_counts.encoding(token_counts.VOCABULARY)
    want = text
    for start, removed, inserted in edits:
        want = want[: min(start, len(want))] + inserted + want[min(start, len(want)) + removed :]
    assert [after[i]["text"] for i in range(1, 6)] == [want, "new text", None, "same", ""]
    for r in after.values():
        assert r["n_tokens"] == len(coder.encode_ordinary(r["text"] or "")) == sum(r["leaf_tokens"])
        assert sum(r["leaf_chars"]) == len(r["text"] or "")


def test_shards_hold_every_record_once(spark, tmp_path):
    rows = [(i, f"text {i % 7}" if i % 5 else None, "x") for i in range(333)] + [(None, "n", "x"), (None, None, "x"), (3, "text 3", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SHARD string")
    out = sharding.shuffled_shards(docs, shards=7, bucket_bytes=900)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((a, b) for a, b, _ in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert rows_of(out, "doc_id", "shard", "slot") == rows_of(sharding.shuffled_shards(docs.repartition(5), shards=7, bucket_bytes=900), "doc_id", "shard", "slot")
    assert sharding.shuffled_shards(docs.limit(0)).count() == 0
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_mix_meets_targets_and_quotas(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), f"s{i % 3}" if i % 4 else None) for i in range(600)] + [(900, None, "s0"), (901, "", "empty")]
    planned = mixing.planned_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=5, block_words=200)
    got = planned.collect()
    words = {i: len((t or "").split()) for i, t, _ in rows}
    assert {r["doc_id"]: r["size"] for r in got} == words and len(got) == len(rows)
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += words[i]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, open_ = {s: 0.0 for s in order}, set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(want[s] for s in order if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] if s in above else share[s] for s in open_}
        if not above:
            break
        open_ -= above
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 10 for s in order)
    mixed = mixing.mixture(planned).collect()
    dealt = {r["doc_id"]: r["mix_shards"] for r in mixing.with_shards(planned).collect()}
    assert {i: sorted(s) for i, s in dealt.items() if s} == {i: sorted(r["mix_shard"] for r in mixed if r["doc_id"] == i) for i in {r["doc_id"] for r in mixed}}
    nameless = spark.createDataFrame([(None, " ".join(["w"] * (i % 40 + 1)), "s") for i in range(400)], "doc_id long, text string, source string")
    assert mixing.planned_documents(nameless, shards=5, block_words=200).select("_block").distinct().count() > 10
    assert Counter(r["doc_id"] for r in mixed) == Counter({r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]})
    assert {r["mix_shard"] for r in mixed} == set(range(5))
    assert mixing.planned_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_quota_tree_is_exact():
    quotas = np.array([17, 0, 5, 100, 1])
    split = mixing.split_quotas(quotas, 6, seed=1)
    assert split.sum(axis=0).tolist() == quotas.tolist() and (split >= 0).all()
    assert split.sum(axis=1).max() - split.sum(axis=1).min() <= 1


def test_vector_groups_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(25, 6))
    rows = [(i, [float(x) for x in centre[i % 25] + rng.normal(size=6) * (i % 9) / 20], i % 3) for i in range(400)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 1), (502, [0.0] * 6, 0), (503, None, 0), (504, rows[0][1], None), (505, [1.0, float("inf")], 0), (506, [1.0, 2.0], 0), (507, [1e30, 2e30], 0)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), cell_rows=40, pack_rows=15, reach=1.0)
    unit = {}
    for i, v, label in rows:
        x = np.array(np.float32(v if v else [0.0]), dtype=np.float64)
        if label is not None and np.isfinite(x).all() and x.any():
            unit[i] = label, len(x), x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links, root = Counter(), {i: i for i, _, _ in rows}
    for a, b in itertools.combinations(sorted(unit), 2):
        if unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= 0.93:
            links[a] += 1
            links[b] += 1
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    assert rows_of(found, "vec_id", "n_links", "component_id", "kept") == sorted(((i, links[i], root[i], root[i] == i) for i, _, _ in rows), key=str)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_of_low_dimension_lose_no_link_between_cells(spark):
    rng = np.random.default_rng(3)
    units = np.float32(rng.normal(size=(1500, 4)) @ np.linalg.qr(rng.normal(size=(64, 4)))[0].T)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(units)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), cell_rows=30, pack_rows=100)
    units = embedding_dedup.unit_rows(units.astype(np.float64))
    want = (units @ units.T >= 0.93).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in found.collect()}
    assert sum(got.values()) == want.sum() and [got[i] for i in range(1500)] == want.tolist()


def test_an_id_under_two_labels_is_no_bridge(spark):
    near, far = [1.0, 0.1], [0.1, 1.0]
    rows = [(1, near, "A"), (2, near, "A"), (1, far, "B"), (3, far, "B"), (4, near, None), (4, near, "C"), (4, near, "C")]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), rows_per_task=2)
    got = rows_of(found, "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (1, 1, 1, True), (3, 1, 1, False), (4, 0, 4, True), (4, 1, 4, True), (4, 1, 4, True)], key=str)


def test_best_path_equals_an_enumeration(spark):
    """Every segmentation of short words, by their weights."""
    pieces = piece_lattice.load_pieces()

    def paths(word):
        if not word:
            yield 0, ()
        for n in range(1, len(word) + 1):
            edge = pieces.edges.get(word[:n])
            if edge or n == 1:
                for cost, rest in paths(word[n:]):
                    here = (edge[0], (edge[1],)) if edge else (piece_lattice.FALLBACK, tuple(pieces.first_byte + b for b in word[:1].encode()))
                    yield here[0] + cost, here[1] + rest

    words = ["the", "thing", "ab cd", "x漢y", "aaaaaa", "Zürich", "q_q", "no 12", "é"]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in piece_lattice.encode(docs, pieces).collect()}
    for i, text in enumerate(words):
        best = max(cost for cost, _ in paths((" " + text).replace(" ", piece_lattice.MARK)))
        assert best == next(c for c, p in paths((" " + text).replace(" ", piece_lattice.MARK)) if list(p) == got[i])


def test_hard_rows_are_encoded_in_any_chunks(spark):
    texts = [None, "", "a", "a", "word " * 40_000, "x" * 300_000, "漢字" * 2_000, "mark \u2581 inside", " two  spaces "]
    rows = [(i % 4 if i % 3 else None, t, "kept", [9], 1) for i, t in enumerate(texts)] + [(None, "a", "kept", [9], 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Ids array<int>, _chunk int")
    pieces = piece_lattice.load_pieces()
    seen = []
    for size in (1 << 30, 100_000):
        found = piece_lattice.decode(piece_lattice.encode(docs, pieces, chunk_bytes=size), pieces).collect()
        assert all(r["round_trip"] and r["source"] == "kept" for r in found)
        assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
        seen.append(sorted((str(r["doc_id"]), str(r["text"])[:50], str(r["ids"])[:200]) for r in found))
    assert seen[0] == seen[1]
