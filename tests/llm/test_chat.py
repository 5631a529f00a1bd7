import hashlib
import random

from turnwise.llm.chat import (chat_digests, fold_events, format_messages, log_of_turns, parse, render, unescape)

NASTY = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "\\|", "<", "|", "\n", "\\n", "<\\|", "é", "", "ok"]


def test_escaping_is_reversible():
    rng = random.Random(1)
    messages = [(rng.choice(["user", "assistant", "a\nb", "<|im_end|>", ""]),
                 "".join(rng.choice(NASTY) for _ in range(rng.randrange(9)))) for _ in range(300)]
    formatted = "".join(render(r, t) for r, t in messages)
    back = list(parse(formatted))
    assert [(r, t) for r, t, _ in back] == messages
    assert all(unescape(formatted[a:b]) == (t if r == "assistant" else "") for r, t, (a, b) in back)
    assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == len(messages)


def test_fold_replays_deltas_edits_and_regenerations(spark):
    log = [(1, 1, "m1", "delta", "user", "he"), (1, 2, "m1", "delta", "user", "llo"),
           (1, 3, "m2", "delta", "assistant", "wrong"), (1, 4, "m2", "regenerate", "assistant", None),
           (1, 5, "m2", "delta", "assistant", "right"), (1, 6, "m2", "delta", "assistant", " now"),
           (1, 7, "m1", "edit", "user", "hi"), (1, 8, "m1", "delta", "user", "!"),
           (1, 9, "m3", "delta", "user", "gone"), (1, 10, "m3", "remove", "user", None),
           (2, 1, "m1", "delta", None, None), (2, 2, "m9", "regenerate", "assistant", "ignored")]
    schema = "conv_id long, seq long, message string, kind string, role string, text string"
    got = sorted((r["conv_id"], r["position"], r["role"], r["text"])
                 for r in fold_events(spark.createDataFrame(log, schema).repartition(3)).collect())
    assert got == [(1, 1, "user", "hi!"), (1, 3, "assistant", "right now"), (2, 1, "", ""), (2, 2, "assistant", "")]


def test_digests_match_the_rows(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]),
             rng.choice([None, "".join(rng.choice(NASTY) for _ in range(6))]), 1)
            for c in range(12) for t in range(rng.choice([1, 2, 9, 300]))]
    rows += [rows[0], rows[5]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int").repartition(4)
    got = {r["conv_id"]: r for r in chat_digests(format_messages(fold_events(log_of_turns(turns)))).collect()}
    assert set(got) == set(range(12))
    for c, r in got.items():
        own = sorted((t, role or "", text or "") for conv, t, role, text, _ in rows if conv == c)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(render(a, b)) for _, a, b in own)
    assert chat_digests(format_messages(fold_events(log_of_turns(turns.limit(0))))).count() == 0


def test_logs_hold_every_kind_of_event_and_fold_back(spark):
    rng = random.Random(5)
    rows = [(c, t if t < 9 else None, rng.choice(["user", "assistant", None]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(12))), "x", 3)
            for c in range(30) for t in range(10)] + [(1, 2, "user", "again", "x", 3)] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string, seq int").repartition(3)
    log = log_of_turns(turns)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"delta", "edit", "regenerate"} and kinds["delta"] > len(rows)
    got = sorted((r["conv_id"], r["role"], r["text"]) for r in fold_events(log.repartition(4)).collect())
    assert got == sorted((c, r or "", t) for c, _, r, t, *_ in rows)
    assert fold_events(log_of_turns(turns.limit(0))).count() == 0


def test_one_shuffle_does_it_all(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat_digests(format_messages(fold_events(log_of_turns(turns))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(conv_id") == 1 and plan.count("Exchange") == 1
