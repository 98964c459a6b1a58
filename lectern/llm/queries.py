"""Queries of the training-data operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import chat, embeddings, mixing, ngram_join, sharding, warc
from .bpe import op5_bpe
from .pii import op6_pii
from .quality_rules import op3_quality_rules
from .secrets import op1_secrets

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_sharding": sharding.op7_sharding,
    "op8_warc": warc.op8_warc,
    "op9_chat": chat.op9_chat,
    "op10_embeddings": embeddings.op10_embeddings,
}

ORACLES: dict[str, str] = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op4_mixing": mixing.oracle(),
    "op7_sharding": sharding.oracle(),
    "op8_warc": warc.ORACLE,
    "op9_chat": chat.ORACLE,
    "op10_embeddings": embeddings.ORACLE,
}
