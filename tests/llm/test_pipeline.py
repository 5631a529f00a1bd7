import random

from made_texts import prose

import corpus_pipeline
from turnwise.llm.common import stored


def write(spark, folder, docs, labels, benchmark):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double") \
        .write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_decides(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, " ".join(prose(rng, 40))) for i in range(5)]
    docs, labels, toxic, leaks, copies = [], [], set(), set(), {}
    for i in range(400):
        words = prose(rng, rng.randrange(60, 200))
        if i % 7 == 0:
            toxic.add(i)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbler", "blockhead", "nitwit"]))
        elif i % 11 == 0:
            leaks.add(i)
            words += items[i % 5][1].split() + prose(rng, 30)
        elif i % 13 == 0 and i > 150:
            first = next(j for j, *_ in docs if j not in toxic | leaks | set(copies) and j > 20)
            copies[i] = first
            words = docs[first][1].split()
            words[3] = "edited"
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0, 1.0))
        labels.append((i, 1, int(i in toxic)))
    docs += [(900, None, None, None, None, None), (901, "", "en", "s1", 0, None)]
    write(spark, tmp_path, docs, labels, items)
    kept = {}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = frame.columns
        frame = stored(stage(spark, frame, str(tmp_path)))
        kept[name] = [r["doc_id"] for r in frame.select("doc_id").collect()]
        assert name == "sharding" or frame.columns == before
    every = {d[0] for d in docs}
    assert set(kept["toxicity"]) == every - toxic
    assert set(kept["ngram_join"]) == every - toxic - set(copies) and len(kept["ngram_join"]) == len(set(kept["ngram_join"]))
    assert set(kept["decontamination"]) == every - toxic - set(copies) - leaks
    assert set(kept["mixing"]) <= set(kept["decontamination"]) - {900, 901} and len(kept["mixing"]) > 250
    assert sorted(kept["sharding"]) == sorted(kept["mixing"])


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
