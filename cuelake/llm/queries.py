"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from cuelake.llm import bpe, chat, decontaminate, filter_audit, languages, near_dups, pii, quality, secrets, substrings, token_files, warc, whitening

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_pii": pii.op2_pii,
    "op3_chat": chat.op3_chat,
    "op4_bpe": bpe.op4_bpe,
    "op5_warc": warc.op5_warc,
    "op6_secrets": secrets.op6_secrets,
    "op7_token_files": token_files.op7_token_files,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_near_dups": near_dups.op9_near_dups,
    "op10_quality": quality.op10_quality,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_whitening": whitening.op12_whitening,
    "op13_languages": languages.op13_languages,
}

ORACLES = {"op3_chat": chat.OP3_SQL, "op5_warc": warc.OP5_SQL, "op11_filter_audit": filter_audit.OP11_SQL, "op13_languages": languages.OP13_SQL}
