"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from codexloom.llm import alignment, bpe, decontaminate, exact_dedup, line_dedup, paragraphs, pii, prefix_trie, quality, simhash, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_warc": warc.op2_warc,
    "op3_paragraphs": paragraphs.op3_paragraphs,
    "op4_simhash": simhash.op4_simhash,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality": quality.op6_quality,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_bpe": bpe.op10_bpe,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op2_warc": warc.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
}
