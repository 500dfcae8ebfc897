"""The numbered queries and their DuckDB SQL, for the driver's entry file."""

from lodestack.llm import bpe, chat, decontaminate, fim, html_extract, line_dedup, quality, simhash, spelling, suffix_dedup, syncmers, token_store, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_chat_format": chat.op2_chat_format,
    "op3_quality": quality.op3_quality,
    "op4_token_store": token_store.op4_token_store,
    "op5_fingerprints": syncmers.op5_fingerprints,
    "op6_bpe": bpe.op6_bpe,
    "op7_warc": warc.op7_warc,
    "op8_simhash": simhash.op8_simhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_main_text": html_extract.op10_main_text,
    "op11_repeated_strings": suffix_dedup.op11_repeated_strings,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_repeated_strings": suffix_dedup.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
