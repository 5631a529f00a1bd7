import random

from made_texts import prose

from turnwise.llm.decontamination import contained_items, without_items


def plain_hits(docs, items):
    out = set()
    for item_id, text in set(items):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        w = min(5, len(words))
        want = {tuple(words[i:i + w]) for i in range(len(words) - w + 1)}
        for doc_id, body in docs:
            own = (body or "").encode().lower().split()
            held = want & {tuple(own[i:i + w]) for i in range(len(own) - w + 1)}
            if 5 * len(held) >= 4 * len(want):
                out.add((doc_id, item_id, len(want), len(held)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(prose(rng, rng.choice([1, 2, 4, 5, 6, 9, 30, 60, 130])))) for i in range(40)]
    items += [(40, None), (41, " \n"), (0, items[0][1]), (42, items[3][1])]
    docs = []
    for i in range(150):
        words = prose(rng, rng.randrange(0, 900))
        if rng.random() < 0.6:
            passage = rng.choice(items[:40])[1].split()
            passage = [w if rng.random() > 0.02 else "changed" for w in passage]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in passage]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    docs += [(500, None), (501, ""), docs[3]]
    got = {tuple(r)[:4] for r in contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()}
    assert got == plain_hits(docs, items) and got


def test_shuffle_join_agrees(spark, monkeypatch):
    from turnwise.llm import decontamination

    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    test_matches_brute_force(spark)


def test_filter_and_edges(spark, documents, no_documents):
    items = spark.createDataFrame([(1, "a b c d e"), (2, "no id here at all")], "item_id long, text string")
    kept = without_items(documents, items)
    assert kept.columns == documents.columns
    texts = [r["text"] for r in kept.collect()]
    assert "a b c d e" not in texts and "A B C D E" not in texts and "no id here at all" not in texts
    assert "two words" in texts and "" in texts
    none = spark.createDataFrame([], "item_id long, text string")
    assert without_items(documents, none).count() == documents.count()
    assert contained_items(no_documents, items).count() == 0
