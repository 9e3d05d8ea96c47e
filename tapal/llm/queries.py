"""Registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from tapal.llm import chat, decontaminate, extract, lexical, lines, merkle, pipeline, quality, simhash, substrings, tokens, voting, warc


def queries() -> dict:
    return {
        "pipeline": pipeline.run,
        "op1_sentencepiece": tokens.op1_sentencepiece,
        "op2_warc": warc.op2_warc,
        "op3_quality": quality.op3_quality,
        "op4_suffix": substrings.op4_suffix,
        "op5_lines": lines.op5_lines,
        "op6_simhash": simhash.op6_simhash,
        "op7_html": extract.op7_html,
        "op8_token_counts": tokens.op8_token_counts,
        "op9_chat": chat.op9_chat,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_wavelet": lexical.op11_wavelet,
        "op12_merkle": merkle.op12_merkle,
        "op13_voting": voting.op13_voting,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_chat": chat.OP9_SQL, "op11_wavelet": lexical.OP11_SQL, "op12_merkle": merkle.OP12_SQL}
