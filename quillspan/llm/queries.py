"""The queries of the training-data operators, and SQL for those that SQL can express."""

from . import exact_dedup, html_text, jaccard_join, license_scan, mixing, quality_rules, sentence_piece, sharding, token_file, tool_chat

QUERIES = {
    "op1_shards": sharding.op1_shards,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_sentencepiece": sentence_piece.op3_sentencepiece,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_mixing": mixing.op7_mixing,
    "op8_tool_chat": tool_chat.op8_tool_chat,
    "op9_token_file": token_file.op9_token_file,
    "op10_html_extraction": html_text.op10_html_extraction,
}

SQL = {"op1_shards": sharding.OP1_SQL, "op4_quality_rules": quality_rules.OP4_SQL, "op5_exact_dedup": exact_dedup.OP5_SQL}
