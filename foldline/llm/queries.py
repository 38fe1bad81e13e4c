"""The queries of this package and their SQL."""

from __future__ import annotations

from foldline.llm import bpe, chat, collocations, decontamination, jaccard, lm, media, merkle, mixing, quality, sharding, token_counts, toxicity

OPERATORS = [(media, "op1"), (sharding, "op2"), (bpe, "op3"), (token_counts, "op4"), (lm, "op5"), (jaccard, "op6"), (decontamination, "op7"), (quality, "op8"), (chat, "op9"), (toxicity, "op10"), (merkle, "op11"), (collocations, "op12"), (mixing, "op13")]


def queries() -> dict:
    return {module.NAME: getattr(module, name) for module, name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {module.NAME: module.SQL for module, _ in OPERATORS if getattr(module, "SQL", None)}
