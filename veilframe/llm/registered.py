"""The queries of this subpackage and their SQL."""

from . import conversations, exact_dedup, jaccard_join, licences, mixing, pieces, quality, substring_dedup, topk, toxicity, url_filter, vector_codes, warc

QUERIES = {
    "op1_warc": warc.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_toxicity": toxicity.query,
    "op8_passages": toxicity.passages_query,
    "op9_top_k": topk.query,
    "op2_quality": quality.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_licences": licences.query,
    "op5_pieces": pieces.query,
    "op6_mixing": mixing.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_url_filter": url_filter.query,
    "op12_vector_codes": vector_codes.query,
    "op13_conversation_repair": conversations.query,
}

ORACLES = {
    "op1_warc": warc.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op9_top_k": topk.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_conversation_repair": conversations.SQL,
}
