"""Queries of the token operators."""

from __future__ import annotations

import public_tokenizers

from steward.llm import bpe_replay, token_records
from steward.llm.common import query, table


@query()
def op2_token_records(spark, sf_dir):
    found = token_records.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path(token_records.TOKENIZER))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op8_bpe_replay(spark, sf_dir):
    ranks = public_tokenizers.path(bpe_replay.RANKS)
    return bpe_replay.tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).drop("ids")
