import pathlib
import random
import time

import numpy as np
import pytest

from cohortal.core.settle import settle
from cohortal.llm import adapt_join, components
from tests.llm.helpers import classes, empty_table, odd_rows, odd_table, prose


def edited(text, seed, n):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    """Near copies around the threshold, chains of them, exact copies, a shared passage, a group of many copies."""
    texts = {}
    shared = prose(99, 60)
    for k in range(25):
        body = prose(seed + k, 120)
        texts[len(texts)] = body
        for j in range(3):
            texts[len(texts)] = edited(body, k * 7 + j, j + 1)
        texts[len(texts)] = body.upper().replace(" ", "\n ")
        texts[len(texts)] = f"{shared} {prose(1000 + k, 100)}"
        texts[len(texts)] = f"{shared} {prose(2000 + k, 12)}"
    chain = prose(5, 200).split()
    for k in range(12):
        chain[k * 15] = f"link{k}"
        texts[len(texts)] = " ".join(chain)
    big = prose(6, 80)
    for k in range(60):
        texts[len(texts)] = edited(big, k, 1)
    return texts


@pytest.mark.parametrize("longest", [1, 6])
def test_classes_equal_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(adapt_join, "LONGEST", longest)
    texts = corpus(10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in adapt_join.document_classes(docs, settle).collect()}
    assert out == classes(texts)


def test_prefixes_hold_every_link():
    """Any two sets with enough in common share at least l tokens of their l-prefixes."""
    rng = random.Random(3)
    for _ in range(300):
        x = set(rng.sample(range(60), rng.randrange(5, 50)))
        y = {t for t in x if rng.random() < 0.93} | set(rng.sample(range(60, 90), rng.randrange(3)))
        if y and 100 * len(x & y) >= 80 * len(x | y):
            for more in (1, 2, 5):
                a = set(sorted(x)[: adapt_join.prefix_length(len(x), more)])
                b = set(sorted(y)[: adapt_join.prefix_length(len(y), more)])
                assert len(a & b) >= min(more, len(x & y))


def test_short_texts_keep_their_links(spark):
    """Sets smaller than LONGEST cannot share as many tokens; nothing more than ceil(t n) may be asked for."""
    texts = {}
    for k in range(24):
        body = [f"{w}{k}" for w in "abcdefghijklmnopqrstuvwx"]
        n = 9 + k % 12
        texts[len(texts)] = " ".join(body[:n])
        texts[len(texts)] = " ".join(body[: n + 1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in adapt_join.document_classes(docs, settle).collect()}
    assert out == classes(texts)
    for n in range(1, 40):
        asked = adapt_join.choose_shared(n, np.arange(n), np.full(n, 2))
        assert 1 <= asked <= -(-n * adapt_join.PERCENT // 100)


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    up = {}

    def top(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    found = components.components(spark.createDataFrame(edges, "a long, b long"), settle)
    assert {r.node: r.label for r in found.collect()} == {k: top(k) for k in up}


def test_odd_rows(spark):
    out = [tuple(r) for r in adapt_join.document_classes(odd_table(spark), settle).collect()]
    assert len(out) == len(odd_rows())
    by_id = {}
    for doc, n, component in out:
        by_id.setdefault(doc, []).append((n, component))
    assert by_id[1] == [(7, 1), (7, 1)] and sorted(by_id[None], key=str) == [(0, None), (7, 1)]
    assert by_id[2] == [(0, 2)] and by_id[3] == [(0, 3)] and by_id[4] == [(0, 4)]
    assert by_id[5] == [(1, 5)] and by_id[6] == [(1, 5)]
    kept = adapt_join.keep_first(odd_table(spark), settle)
    assert kept.columns == odd_table(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, None, 3, 4, 5, 7, 8, 9]))
    assert adapt_join.document_classes(empty_table(spark), settle).count() == 0
    assert adapt_join.keep_first(empty_table(spark), settle).count() == 0


def test_kept_rows_are_found_without_shuffling_texts(spark, monkeypatch):
    """Row numbers of several partitions, either side of a bitmap's end; few or many bitmaps give the same rows."""
    numbers = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 1 << 33, (1 << 33) + 1, (5 << 33) + 40000]
    numbered = settle(spark.createDataFrame([(n, f"text {n}") for n in numbers], "_row long, text string"), "numbered")
    kept = numbers[::2] + numbers[-1:]
    bitmaps = settle(adapt_join._bitmaps(spark.createDataFrame([(n,) for n in kept], "id long")), "kept")
    found = lambda: sorted(r["_row"] for r in adapt_join._marked(numbered, bitmaps).collect())
    assert found() == sorted(kept)
    monkeypatch.setattr(adapt_join, "FEW_BITMAPS", 0)
    assert found() == sorted(kept)
    monkeypatch.undo()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = adapt_join.keep_first(odd_table(spark), settle)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_links_grow_with_the_documents_not_with_their_square(spark, monkeypatch):
    """Near copies of one text: five times the documents give at most five times the links, fewer than there are documents."""
    monkeypatch.setattr(adapt_join, "CHUNK", 20)
    inner, seen = adapt_join.components, []

    def recorded(edges, settle):
        seen.append(edges.count())
        return inner(edges, settle)

    monkeypatch.setattr(adapt_join, "components", recorded)
    links = {}
    for n in (60, 300):
        body = prose(7, 120)
        texts = {k: edited(body, k, 1) for k in range(n)}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        seen.clear()
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in adapt_join.document_classes(docs, settle).collect()}
        assert out == classes(texts)
        links[n] = seen[-1]
    assert 0 < links[300] <= 6 * links[60] and links[300] < 2 * 300


def test_ids_of_any_type_and_ties(spark):
    text = prose(3, 120)
    rows = [("b2", text), ("a1", text), ("c", edited(text, 1, 1)), (None, text), ("z", "other words"), ("a1", text)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = sorted(((r.doc_id, r.component_id) for r in adapt_join.document_classes(docs, settle).collect()), key=str)
    assert {c for d, c in out if d != "z"} == {"a1"} and ("z", "z") in out and len(out) == 6
    kept = adapt_join.keep_first(docs, settle).collect()
    assert sorted(r.doc_id for r in kept) == ["a1", "z"]


def test_only_the_sets_of_pairs_are_shuffled(spark, monkeypatch):
    """Two pairs name four sets of many; the others stay where they are, and many pairs give the same links."""
    from cohortal.llm.blocks import pack

    rows = [(k, bytearray(pack(np.arange(k // 2 * 100, k // 2 * 100 + 50, dtype=np.uint64), True))) for k in range(200)]
    sets = settle(spark.createDataFrame(rows, "rid long, set binary"), "sets")
    pairs = settle(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"), "pairs")
    assert sorted(r.rid for r in adapt_join.only_named(sets, pairs.select("a"), pairs.select("b")).collect()) == [0, 1, 2]
    plan = adapt_join.verify(pairs, sets)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and plan.count("strategy=broadcast") == 2
    few = adapt_join.verify(pairs, sets).collect()
    monkeypatch.setattr(adapt_join, "FEW_IDS", 0)
    assert [tuple(r) for r in few] == [tuple(r) for r in adapt_join.verify(pairs, sets).collect()] == [(0, 1)]


def test_whole_sets_travel_only_where_prefixes_leave_a_pair_open(spark, monkeypatch):
    """Documents that share a short passage are a family, but no two can be similar enough; near copies among them still link."""
    rng = random.Random(4)
    common = [f"w{k}" for k in range(80)]
    body = lambda: " ".join(rng.choices(common, k=150))
    passage = " ".join(f"rare{k}" for k in range(10))
    texts = {k: f"{passage} {body()}" if k < 12 else body() for k in range(40)}
    inner, seen = adapt_join._compare, []

    def recorded(blocks, keys):
        seen.append(sorted({r.rid for r in blocks.select("rid").collect()}))
        return inner(blocks, keys)

    monkeypatch.setattr(adapt_join, "_compare", recorded)
    for more in ({}, {40: edited(texts[3], 1, 2), 41: edited(texts[5], 2, 3)}):
        texts |= more
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in adapt_join.document_classes(docs, settle).collect()}
        assert out == classes(texts)
        if not more:
            assert [len(s) for s in seen] == [0, 0]
        monkeypatch.setattr(adapt_join, "LEADER_ROUNDS", 1)


@pytest.mark.parametrize("few", [0, 10**6])
def test_blocks_give_the_links_of_all_pairs(spark, monkeypatch, few):
    """Many near copies of one text, around the threshold, in small blocks; few or many places, few or many ids."""
    monkeypatch.setattr(adapt_join, "CHUNK", 8)
    monkeypatch.setattr(adapt_join, "FEW_ROWS", few)
    monkeypatch.setattr(adapt_join, "FEW_IDS", few)
    monkeypatch.setattr(adapt_join, "SETS_AT_ONCE", 3)
    body = prose(8, 100)
    texts = {k: edited(body, k, k % 4) for k in range(45)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in adapt_join.document_classes(docs, settle).collect()}
    assert out == classes(texts)


def test_longest_prefixes_of_similar_sets_share_enough_and_their_bands_touch():
    """What a document is dropped for, and the band it meets others in, lose no link."""
    rng = random.Random(11)
    band = lambda n: int(np.floor(np.log(n) / np.log(adapt_join.BAND)))
    seen = 0
    for _ in range(400):
        x = set(rng.sample(range(100), rng.randrange(1, 80)))
        y = {t for t in x if rng.random() < 0.93} | set(rng.sample(range(100, 130), rng.randrange(3)))
        if y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = (set(sorted(s)[: adapt_join.prefix_length(len(s), adapt_join.LONGEST)]) for s in (x, y))
            assert len(a & b) >= max(adapt_join.least_shared(len(x)), adapt_join.least_shared(len(y)))
            seen += 1
    assert seen > 100
    for n in range(1, 3000):
        assert band(n * 100 // adapt_join.PERCENT) - band(n) <= 1


def test_documents_without_a_possible_partner_are_in_no_block(spark, monkeypatch):
    """Of many documents with one passage, those that share too little or are of other sizes do not meet in blocks."""
    rng = random.Random(12)
    common = [f"w{k}" for k in range(80)]
    body = lambda n: " ".join(rng.choices(common, k=n))
    short, long = (" ".join(f"{w}{k}" for k in range(n)) for w, n in (("short", 10), ("long", 40)))
    texts = dict(enumerate([f"{short} {body(150)}" for _ in range(12)] + [f"{long} {body(n)}" for n in (60, 120, 250, 600) for _ in range(4)]))
    inner, seen = adapt_join._block_links, []

    def recorded(places, *more):
        seen.append(places.count())
        return inner(places, *more)

    monkeypatch.setattr(adapt_join, "_block_links", recorded)
    monkeypatch.setattr(adapt_join, "LEADER_ROUNDS", 1)
    for k, (of, edits) in enumerate([(1, 0), (13, 1), (17, 2), (27, 2)]):
        texts[28 + k] = edited(texts[of], k, edits)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in adapt_join.document_classes(docs, settle).collect()}
    assert out == classes(texts) and len({c for _, c in out.values()}) < len(texts)
    assert seen == [0, 0]


def test_tables_and_shuffle_files_go_as_soon_as_they_are_read(spark, monkeypatch):
    """When the last pairs are verified, only what is still to be read is on disk, and no settled table left shuffle files."""
    from pyspark.sql import functions as F

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {str(f.getName()) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = shuffled()
    made = components.Scratch(settle)(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "made")
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffled() - before and made.count() == 7

    inner, seen, alive = adapt_join.verify, [], {}

    def kept(df, label):
        out = settle(df, label)
        alive[out._settled_path] = label
        return out

    def recorded(pairs, sets):
        there = {k for p, k in alive.items() if pathlib.Path(p.removeprefix("file://")).exists()}
        seen.append(there)
        return inner(pairs, sets)

    monkeypatch.setattr(adapt_join, "verify", recorded)
    texts = {k: edited(prose(8, 100), k, k % 4) for k in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in adapt_join.document_classes(docs, kept).collect()}
    assert out == classes(texts)
    assert seen[-1] == {"join-rows", "join-classes", "join-shared", "join-edges", "join-pairs", "join-sets"}
