"""The corpus queries and their SQL."""

from __future__ import annotations

from . import ctw, decontamination, fingerprints, langid, licences, lines, merkle, mixing, runs, simhash, token_ids, toxicity, urls

QUERIES = {
    "op1_ctw": ctw.op1_ctw,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_licence_scan": licences.op3_licence_scan,
    "op4_url_filters": urls.op4_url_filters,
    "op5_mixing": mixing.op5_mixing,
    "op6_simhash": simhash.op6_simhash,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_ids": token_ids.op11_token_ids,
    "op12_runs": runs.op12_runs,
    "op13_merkle": merkle.op13_merkle,
}
SQL = {
    "op3_licence_scan": licences.OP3_SQL,
    "op4_url_filters": urls.OP4_SQL,
}
