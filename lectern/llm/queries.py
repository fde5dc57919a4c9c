"""The registered queries of this subpackage and their oracle SQL."""

from . import byte_bpe, chat_format, decontaminate, embedding_dedup, filter_audit, hmm_lm, html_extract, ngram_join, pii, prefix_trie, secrets, token_counts, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_token_counts": token_counts.query,
    "op3_toxicity": toxicity.query,
    "op4_hmm_lm": hmm_lm.query,
    "op5_chat_format": chat_format.query,
    "op6_secrets": secrets.query,
    "op7_ngram_join": ngram_join.query,
    "op8_pii": pii.query,
    "op9_byte_bpe": byte_bpe.query,
    "op10_embedding_dedup": embedding_dedup.query,
    "op11_html_extract": html_extract.query,
    "op12_filter_audit": filter_audit.query,
    "op13_prefix_trie": prefix_trie.query,
}
ORACLE_SQL = {
    "op5_chat_format": chat_format.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
