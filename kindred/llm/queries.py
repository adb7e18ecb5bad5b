"""Named queries of the corpus operators and the SQL that gives the same rows."""

from kindred.llm import bpe, lines, mixing, neardup, quality, search, secrets, sharding, suffixes, toxicity, trie, vectors, whitening

QUERIES = {
    "op1_jaccard_join": neardup.op1_jaccard_join,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_near_vectors": vectors.op5_near_vectors,
    "op6_vector_packing": sharding.op6_vector_packing,
    "op7_quality": quality.op7_quality,
    "op8_secret_ledger": secrets.op8_secret_ledger,
    "op9_block_max_search": search.op9_block_max_search,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_whitening": whitening.op12_whitening,
    "op13_conversation_trie": trie.op13_conversation_trie,
}

ORACLES = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op9_block_max_search": search.OP9_SQL,
    "op13_conversation_trie": trie.OP13_SQL,
}
