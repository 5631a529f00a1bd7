import collections
import random
import re

from turnwise.llm.rules import STATISTICS, apply_rules, learn_rules, quality_rules, text_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    seen = collections.Counter(grams)
    covered = {p for k, g in enumerate(grams) if seen[g] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_statistics_match_a_plain_count(spark, documents):
    rng = random.Random(1)
    texts = [r["text"] for r in documents.select("text").collect()]
    for _ in range(60):
        words = [rng.choice("a b # $x yy é  z| <t> Wort".split(" ")) for _ in range(rng.randrange(60))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words))
    block = " ".join(f"r{i}" for i in range(10))
    texts += [f"{block} {block}", f"{block} and {block} or {block}", "same line\nsame line\n\nsame line"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in text_statistics(docs).collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts)}


def test_base_verdict_and_edges(spark, documents, no_documents):
    rows = apply_rules(documents, []).collect()
    assert len(rows) == documents.count()
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert apply_rules(no_documents, []).count() == 0


def test_learns_a_conjunction(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, b = rng.random(), rng.random()
        values = {s: 0.0 for s in STATISTICS} | {"upper_share": a, "mark_share": b}
        rows.append((i, int(not (a > 0.6 and b > 0.5)), *[values[s] for s in STATISTICS]))
    table = spark.createDataFrame(rows, "doc_id long, label int, " + ", ".join(f"{s} double" for s in STATISTICS))
    rules = learn_rules(table)
    assert rules and {c.statistic for c in rules[0].conditions} == {"upper_share", "mark_share"}
    from turnwise.llm.rules import verdict

    wrong = table.filter(verdict(rules).cast("int") != table["label"]).count()
    assert wrong <= 30


def test_without_labels_every_verdict_is_keep(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules(documents, labels) == []
