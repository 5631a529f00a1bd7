import functools
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from turnwise.llm.tokens import batches_by_bytes, safe_pieces, token_counts  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def whole(text):
    return len(tokenizer().encode(text or "", add_special_tokens=False))


def test_pieces_never_change_the_count():
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "don't", "<|endoftext|>", "é", "12", "!", "　", "\x1c", "'s", "日本", "\t"]
    for _ in range(200):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(120)))
        pieces = safe_pieces(text, 7)
        assert "".join(pieces) == text
        assert sum(map(whole, pieces)) == whole(text)


def test_batches_are_balanced():
    pieces = [(i, "x" * (i % 50)) for i in range(400)]
    runs = list(batches_by_bytes(pieces, 200))
    assert [p for run in runs for p in run] == pieces
    assert all(sum(len(p) for _, p in run) <= 200 for run in runs)


def test_counts(spark, documents, no_documents):
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), whole(r["text"])) for r in documents.collect())
    got = token_counts(documents, VOCABULARY).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts(no_documents, VOCABULARY).count() == 0
