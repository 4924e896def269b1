"""The subpackage's queries and the SQL they are compared with."""

from __future__ import annotations

from . import conversations, decontamination, embeddings, mixing, packed, quality, sharding, simhash, tokens, toxicity, url_filter, vector_codes, warc

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_toxicity": toxicity.query,
    "op3_quality": quality.query,
    "op4_url_filter": url_filter.query,
    "op5_embedding_dedup": embeddings.query,
    "op6_warc": warc.query,
    "op7_mixing": mixing.query,
    "op8_simhash_dedup": simhash.query,
    "op9_sharding": sharding.query,
    "op10_token_counts": tokens.query,
    "op11_conversation_repair": conversations.query,
    "op12_vector_codes": vector_codes.query,
    "op13_packed_ids": packed.query,
}

SQL = {
    "op1_decontamination": decontamination.SQL,
    "op5_embedding_dedup": embeddings.SQL,
    "op6_warc": warc.SQL,
    "op7_mixing": mixing.SQL,
    "op9_sharding": sharding.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
