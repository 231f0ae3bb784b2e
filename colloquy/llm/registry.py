"""The subpackage's queries and their SQL."""

from __future__ import annotations

from colloquy.llm.op1_bm25 import op1_bm25_top_k
from colloquy.llm.op2_shards import op2_token_shards
from colloquy.llm.op3_repeats import op3_repeated_bytes
from colloquy.llm.op4_tools import OP4_SQL, op4_tool_links
from colloquy.llm.op5_units import OP5_EVERY_SQL, OP5_SQL, op5_every_line, op5_substring_dedup
from colloquy.llm.op6_html import op6_main_text
from colloquy.llm.op7_jaccard import op7_jaccard_join
from colloquy.llm.op8_quality import op8_weak_quality
from colloquy.llm.op9_phrases import OP9_SQL, op9_phrase_decontamination
from colloquy.llm.op10_bpe import op10_byte_bpe


def queries() -> dict:
    return {"op1_bm25_top_k": op1_bm25_top_k, "op2_token_shards": op2_token_shards, "op3_repeated_bytes": op3_repeated_bytes, "op4_tool_links": op4_tool_links, "op5_substring_dedup": op5_substring_dedup, "op5_every_line": op5_every_line, "op6_main_text": op6_main_text, "op7_jaccard_join": op7_jaccard_join, "op8_weak_quality": op8_weak_quality, "op9_phrase_decontamination": op9_phrase_decontamination, "op10_byte_bpe": op10_byte_bpe}


def oracle_sql() -> dict:
    return {"op4_tool_links": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op5_every_line": OP5_EVERY_SQL, "op9_phrase_decontamination": OP9_SQL}
