"""The subpackage's queries and their SQL, for the registry at the top."""

from __future__ import annotations

from spindrift.llm import queries as q, sql


def queries():
    return {
        "op1_mix_sources": q.op1_mix_sources,
        "op2_simhash": q.op2_simhash,
        "op3_token_files": q.op3_token_files,
        "op4_language_id": q.op4_language_id,
        "op5_html_text": q.op5_html_text,
        "op6_decontaminate": q.op6_decontaminate,
        "op7_exact_dedup": q.op7_exact_dedup,
        "op8_chat_preferences": q.op8_chat_preferences,
        "op9_repeats": q.op9_repeats,
        "op10_url_filters": q.op10_url_filters,
        "op11_periodic_runs": q.op11_periodic_runs,
        "op12_whitening": q.op12_whitening,
        "op13_pieces": q.op13_pieces,
    }


def oracle_sql():
    """Of the others, tests compare with a brute-force version, an exact round trip or held-out accuracy."""
    return {"op6_decontaminate": sql.DECONTAMINATE, "op7_exact_dedup": sql.EXACT_DEDUP, "op8_chat_preferences": sql.CHAT}
