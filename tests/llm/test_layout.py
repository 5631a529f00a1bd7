import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnwise.llm.curriculum import curriculum, mixed
from turnwise.llm.shards import stratified_shards, training_shards


def sourced(spark, seed=1, n=3000):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "hot" if i % 3 == 0 else None if i % 17 == 0 else f"s{i % 7}")
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_shards_hold_the_corpus_mixture(spark):
    rows, docs = sourced(spark)
    got = stratified_shards(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(24))
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    all_sources = Counter(s for _, _, s in rows)
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
        for s, n in all_sources.items():
            assert abs(sum(r["source"] == s for r in shard) - n / 24) <= 1.5
    text = {i: t for i, t, _ in rows}
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
               for r in got)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in stratified_shards(docs.repartition(2)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_shards_edges(spark, documents, no_documents):
    got = stratified_shards(documents).collect()
    assert len(got) == documents.count()
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert stratified_shards(no_documents).count() == 0


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, left, open_ones = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        total = sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_ones}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ones -= full
        if not open_ones:
            return target


def test_mix_meets_its_targets(spark):
    rows, docs = sourced(spark, 2)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    taken = Counter()
    for r in curriculum(docs).collect():
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first_time"] is None) == (r["taken"] == 0)
        assert r["first_time"] is None or 0 <= r["first_time"] <= r["last_time"] <= 1
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)


def test_training_time_follows_the_schedules(spark):
    """Words demanded by half time match the integral of each source's weight."""
    rows, docs = sourced(spark, 3)
    half = Counter()
    total = Counter()
    for r in curriculum(docs).collect():
        for t in r["times"]:
            half[r["source"]] += r["size"] if t <= 0.5 else 0
        total[r["source"]] += r["taken"]
    order = sorted(s for s in total if s is not None) + [None]
    for i, s in enumerate(order):
        start, end = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))[i % 3]
        share = (start * 0.5 + (end - start) * 0.125) / ((start + end) / 2)
        assert half[s] / total[s] == pytest.approx(share, abs=0.03)


def test_mixed_rows_are_whole_documents(spark, documents, no_documents):
    rows, docs = sourced(spark, 4)
    out = mixed(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    passes = {r["doc_id"]: r["passes"] for r in curriculum(docs).collect() if r["passes"]}
    assert counts == passes and max(counts.values()) == 2
    edge = mixed(documents)
    assert edge.columns == documents.columns and edge.filter(F.col("text").isNull() | (F.trim("text") == "")).count() == 0
    assert mixed(no_documents).count() == 0 and curriculum(no_documents).count() == 0


def test_sizes_are_words(spark, documents):
    got = sorted((r["doc_id"], r["size"]) for r in curriculum(documents).collect() if r["doc_id"] is not None)
    want = sorted((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
                  for r in documents.collect() if r["doc_id"] is not None)
    assert got == want


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "s", 1, 2, 3) for i in range(9)],
                                 ["doc_id", "text", "source", "a.b", "_doc", "_time"])
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() > 9


def test_places_match_plain_ranking(spark):
    """Shard and slot from sorting, with no ranges: fractional ranks per source, then one sorted list that is cut."""
    rows, docs = sourced(spark, 11, 700)
    key = lambda i: hashlib.md5(f"shards:{i}".encode()).hexdigest()
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    ranked = []
    for s, ids in by.items():
        for rank, i in enumerate(sorted(ids, key=key)):
            ranked.append(((rank + 0.5) / len(ids), "" if s is None else "=" + s, key(i), i))
    ranked.sort()
    want, slots = {}, Counter()
    for place, (*_, i) in enumerate(ranked):
        shard = place * 24 // len(ranked)
        want[i] = (shard, slots[shard])
        slots[shard] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in stratified_shards(docs).collect()} == want


def test_shards_of_a_mix_are_read_in_training_order(spark):
    _, docs = sourced(spark, 5)
    mix = mixed(docs)
    times = {r["doc_id"]: r["times"][:r["passes"]] for r in curriculum(docs).collect() if r["passes"]}
    got = training_shards(mix).collect()
    assert len(got) == mix.count() == sum(map(len, times.values()))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert r["time"] == pytest.approx(times[r["doc_id"]][r["nth"] - 1], abs=0.01)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) <= 1
    for rows in by.values():
        rows.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        assert all(a["time"] <= b["time"] for a, b in zip(rows, rows[1:]))
    # Two passes over one document are placed independently: not in one shard more often than chance puts them.
    both = [[r["shard"] for r in got if r["doc_id"] == d] for d, t in times.items() if len(t) == 2]
    assert len(both) > 300 and sum(a == b for a, b in both) < 0.1 * len(both)
    assert training_shards(mix.limit(0)).count() == 0
