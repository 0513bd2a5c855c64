"""Queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import chat, decontaminate, langid, linededup, mixing, quality, sharding, simhash, tokenfiles, toxicity


def queries() -> dict:
    return {
        "op1_language_id": langid.op1,
        "op2_chat_formatting": chat.op2,
        "op3_decontamination": decontaminate.op3,
        "op4_source_mixing": mixing.op4,
        "op5_simhash_dedup": simhash.op5,
        "op6_host_quality": quality.op6,
        "op7_line_dedup": linededup.op7,
        "op8_toxicity": toxicity.op8,
        "op9_ring_sharding": sharding.op9,
        "op10_token_files": tokenfiles.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": chat.OP2_SQL,
        "op3_decontamination": decontaminate.OP3_SQL,
        "op4_source_mixing": mixing.OP4_SQL,
        "op6_host_quality": quality.OP6_SQL,
        "op7_line_dedup": linededup.OP7_SQL,
    }
