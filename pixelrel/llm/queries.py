"""The training-data queries, one per operator, and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import alignment, chat, dedup, embeddings, lm, mixing, packing, secrets, sharding, simhash, toxicity, trie, warc

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity, sharding.op2_sharding, secrets.op3_secret_scan, dedup.op4_exact_dedup, chat.op5_chat_tools,
        packing.op6_best_fit_packing, mixing.op7_source_mixing, warc.op8_warc_revisits, simhash.op9_simhash_golay, embeddings.op10_embedding_dedup,
        lm.op11_lm_scoring, alignment.op12_tokenizer_alignment, trie.op13_prefix_trie,
    )
}
SQL = {"op4_exact_dedup": dedup.SQL, "op8_warc_revisits": warc.SQL, "op10_embedding_dedup": embeddings.SQL, "op13_prefix_trie": trie.SQL}
