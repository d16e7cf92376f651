"""The subpackage's queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import arc_convert, audio, chat_format, exact_dedup, line_dedup, mixing, packing, quality, simhash, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_audio_match": audio.op2_audio_match,
    "op3_arc_convert": arc_convert.op3_arc_convert,
    "op4_quality": quality.op4_quality,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_packing": packing.op6_packing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL = {
    "op3_arc_convert": arc_convert.OP3_SQL,
    "op5_chat_format": chat_format.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
