import random

import pyarrow as pa
import pytest
from made_texts import prose

from turnwise.llm import ngram_join
from turnwise.llm import components as components_module
from turnwise.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    seen = set()
    for held in holders.values():
        for i in held:
            for j in held:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((d, len(sets[i]), least.get(find(i), None)) for i, (d, _) in enumerate(rows) if d is not None)


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus(seed, groups=12, copies=8):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for _ in range(groups):
        base = prose(rng, rng.choice([4, 5, 6, 30, 200, 400]))
        for _ in range(rng.randrange(1, copies)):
            words = edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04]))
            if rng.random() < 0.3:
                words = words + passage
            if rng.random() < 0.3:
                words = words[:rng.randrange(1, len(words) + 1)]
            rows.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in words))
    rng.shuffle(rows)
    return [(1000 + 7 * i, t) for i, t in enumerate(rows)]


def joined(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in ngram_join.ngram_components(docs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert joined(spark, rows) == plain_components(rows)


def test_chunked_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    rng = random.Random(4)
    base = prose(rng, 120)
    rows = [(i, " ".join(edited(rng, base, 0.012))) for i in range(60)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(corpus(6, groups=6))]
    assert joined(spark, rows) == plain_components(rows)


def test_edges(spark, documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in ngram_join.ngram_components(documents).collect() if r["doc_id"] is not None))
    assert got == plain_components(rows)
    assert ngram_join.ngram_components(no_documents).count() == 0


def test_one_of_each_keeps_the_smallest_id(spark, documents):
    kept = ngram_join.one_of_each(documents)
    assert kept.columns == documents.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [0, 1, 2, 3, 4, 5, 7, 8]  # 6 has the words of 5; rows 1 and 4 were there again


def near(words, *at):
    return " ".join("new" + str(i) if i in at else w for i, w in enumerate(words))


def test_links_pass_through_rows_without_id(spark):
    """A - B - C, where A and C are too far apart to link and B has no doc_id."""
    words = prose(random.Random(21), 103)
    rows = [(1, near(words, 10, 20)), (None, near(words)), (2, near(words, 50, 60)), (3, "alone " * 3)]
    assert joined(spark, rows[:1] + rows[2:]) == [(1, 99, 1), (2, 99, 2), (3, 1, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs).collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(docs).collect()) == [1, 3]


def test_an_id_on_several_texts_takes_none_along(spark):
    words, other = prose(random.Random(22), 60), prose(random.Random(23), 60)
    rows = [(1, " ".join(words)), (5, near(words, 0)), (5, " ".join(other)), (5, " ".join(other).upper())]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"].lower()) for r in kept) == [(1, rows[0][1]), (5, rows[2][1])]
    without = [(None, near(words, 0)), (None, " ".join(words)), (None, None), (None, "")]
    kept = ngram_join.one_of_each(spark.createDataFrame(without, "doc_id long, text string")).collect()
    assert len(kept) == 3


def test_columns_of_any_name(spark):
    names = ["row", "id", "k", "gone_id", "gone_k", "_gone", "again_id", "component", "a.b", "_again"]
    rows = [(i % 4, ["one two three four five six", "x y"][i % 2], *range(10)) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1]


def test_frequent_shingles_pass_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    rows = [(1, 10, 3)] + [(2, k, 9) for k in range(17)] + [(3, 1, 3), (3, 2, 3)]
    rows = sorted(rows + [(2, 4, 9), (3, 2, 3)])
    for size in (1, 2, 3, 7, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + size])], ["shingle", "k", "n"])
                   for i in range(0, len(rows), size)]
        out = sorted(row for b in ngram_join._shared(iter(batches)) for k, n, t in zip(*[c.to_pylist() for c in b.columns])
                     for row in [(t & (1 << 48) - 1, k, n, t >> 48)])
        assert out == sorted([(2, k, 9, 5) for k in range(17)] + [(3, 1, 3, 2), (3, 2, 3, 2)]), size


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_components_of_a_path_and_a_star(spark, monkeypatch, small):
    monkeypatch.setattr(components_module, "SMALL_EDGES", small)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
            if sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}


@pytest.mark.parametrize("chunk", [1000, 7])
def test_no_link_is_lost(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = random.Random(8)
    base = prose(rng, 200)
    rows = [(i, " ".join(edited(rng, base, 0.008))) for i in range(30)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(corpus(9, groups=5))] + [(900, ""), (901, rows[3][1]), (902, rows[3][1])]
    wanted = plain_links(rows)
    assert len(wanted) > 2 * len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_link_counts(docs).collect()}
    assert counted == {d: sum(i in pair for pair in wanted) for i, (d, _) in enumerate(rows)}
    pairs, members = ngram_join.ngram_links(docs)
    pairs = [tuple(r) for r in pairs.collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    of = {r["doc_id"]: (r["class_id"], r["n_shingles"]) for r in members.collect()}
    ids = [d for d, _ in rows]
    linked = {(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))
              if (min(of[ids[i]], of[ids[j]])[0], max(of[ids[i]], of[ids[j]])[0]) in set(pairs)
              or of[ids[i]] == of[ids[j]] and of[ids[i]][1]}
    assert linked == wanted


def test_link_counts_of_edges(spark, documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    wanted = plain_links(rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_links"]) for r in ngram_join.ngram_link_counts(documents).collect())
    assert got == sorted((d is None, d or 0, sum(i in pair for pair in wanted)) for i, (d, _) in enumerate(rows))
    assert ngram_join.ngram_link_counts(no_documents).count() == 0
