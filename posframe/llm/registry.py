"""The llm queries by name, and the DuckDB SQL of those that SQL can express."""

from posframe.llm import ann, bpe, lm, packing, quality, simhash, substrings, vafile, warc, wrappers

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_vafile": vafile.op2_vafile,
    "op3_packing": packing.op3_packing,
    "op4_lm_scores": lm.op4_lm_scores,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_bpe_roundtrip": bpe.op6_bpe_roundtrip,
    "op7_warc": warc.op7_warc,
    "op8_main_text": wrappers.op8_main_text,
    "op9_quality": quality.op9_quality,
    "op10_simhash": simhash.op10_simhash,
}
ORACLE_SQL = {
    "op2_vafile": vafile.OP2_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
}
