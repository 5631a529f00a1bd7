import hashlib
import random
import re

from turnwise.llm.pii import BASE_KINDS, LABELERS, decided_spans, find_pii, proposed_spans, vote_posteriors

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, hit):
    digits = re.sub(r"\D", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


PARTS = ["a@b.c", ".d@x.y-z", "_e@f.g", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.255", ".5.6.7.8", "+1 (555) 123-4567",
         "+49 30 1234567", "+1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", " ", "é", "\U0001F600",
         "12", "-", "(", "\n", "token = \"04dbebab91ab85687d33eeaaf9ac\"", "123-45-6789"]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] or [] for r in find_pii(docs).collect()}


def test_base_spans_match_plain_search(spark, documents):
    rng = random.Random(3)
    texts = [r["text"] for r in documents.select("text").collect()]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    texts += ["1.1.1.1 " * 700, "a" * 50_000, "9" * 50_000, "a@b" + ".c" * 20_000, "+1" + " (" * 20_000]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        spans = [(s["kind"], s["start"], s["stop"]) for s in got[i] if s["base"]]
        assert spans == base_spans(text), (i, (text or "")[:80])
        added = [s for s in got[i] if not s["base"]]
        assert not any(s["kind"] in BASE_KINDS for s in added)
        assert not any(a["start"] < b and s < a["stop"] for a in added for _, s, b in spans)


def test_secrets_are_added_after_cues(spark):
    rng = random.Random(9)
    texts = [f"plain words here token = \"{rng.getrandbits(160):040x}\" and on" for _ in range(40)]
    got = found(spark, texts)
    assert sum(any(s["kind"] == "secret" for s in got[i]) for i in range(40)) >= 38


def test_empty_table(spark, no_documents):
    proposed = proposed_spans(no_documents)
    assert decided_spans(proposed, {}).count() == 0
    assert find_pii(no_documents).count() == 0


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        votes = tuple((1 if real else -1) if rng.random() < q else (-1 if real else 1) for q in (0.95, 0.9, 0.9, 0.55, 0.5))
        counts["k", votes] = counts.get(("k", votes), 0) + 1
    assert len(LABELERS) == 5
    p = vote_posteriors(counts)
    assert p["k", (1, 1, 1, -1, -1)] > 0.95 and p["k", (-1, -1, -1, 1, 1)] < 0.05


def test_query_columns(spark, tmp_path):
    from turnwise.llm.pii import op2_pii_votes

    text = "mail me.x@site.org now, ip 10.0.0.1"
    spark.createDataFrame([(5, text), (6, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op2_pii_votes(spark, str(tmp_path)).collect()}
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))
    assert (rows[5]["n_email"], rows[5]["n_ip"], rows[5]["n_card"], rows[5]["n_phone"]) == (1, 1, 0, 0)
    assert rows[5]["spans"] == listed and rows[5]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert rows[6]["spans"] == "" and rows[6]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_recall_of_added_kinds(spark):
    """Planted spans of each added kind among prose that uses the same words without any."""
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    run = lambda n, alphabet=letters: "".join(rng.choice(alphabet) for _ in range(n))
    shapes = {
        "keyed_secret": lambda: rng.choice(['password: {}', 'api_key="{}"', "token = {}", "the secret={}", "Authorization: Bearer {}"]).format(
            rng.choice([lambda: "AKIA" + run(12, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), lambda: f"{run(6)}-{run(5)}_{run(4)}9a", lambda: run(9) + "7Qx",
                        lambda: f"hunter{rng.randrange(100)}!Pass"])()),
        "secret": lambda: f"token = {rng.getrandbits(160):040x}",
        "national_id": lambda: f"SSN {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "local_phone": lambda: f"call ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"}
    texts, planted = [], []
    for i in range(240):
        kind = list(shapes)[i % 4]
        texts.append(f"some plain words here, {shapes[kind]()} and then some more of them.")
        planted.append(kind)
    plain = ["The secret ingredients were many.", "His password protection failed, she said.", "A token gesture: something else entirely.",
             "The key differences remain unclear.", "Keep the credentials confidential please.", "bearer something nothing"] * 20
    got = found(spark, texts + plain)
    for kind in shapes:
        own = [i for i, k in enumerate(planted) if k == kind]
        hit = sum(any(s["kind"] == kind or (kind == "keyed_secret" and s["kind"] == "secret") for s in got[i]) for i in own)
        assert hit >= 0.9 * len(own), (kind, hit, len(own))
    assert not any(got[i] for i in range(len(texts), len(texts) + len(plain)))
