"""Imports every module of this subpackage that registers queries."""
from __future__ import annotations

from turnwise.llm import (chat, curriculum, decontamination, ngram_join, pii, quality_model, repair, rules,  # noqa: F401
                          shards, tokens, toxicity, warc, whitening)  # noqa: F401
from turnwise.llm.registry import ORACLE, QUERIES  # noqa: F401
