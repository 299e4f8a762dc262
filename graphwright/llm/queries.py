"""The queries of this subpackage by name, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from . import cotrain, jaccard, langid, licences, media, mixing, negatives, pages, pieces, repeats, secrets, simhash, topk

QUERIES = {
    "op1_quality": cotrain.op1_quality,
    "op2_secrets": secrets.op2_secrets,
    "op3_topk": topk.op3_topk,
    "op4_mixing": mixing.op4_mixing,
    "op5_media": media.op5_media,
    "op6_language": langid.op6_language,
    "op7_pieces": pieces.op7_pieces,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_licences": licences.op9_licences,
    "op10_pages": pages.op10_pages,
    "op11_runs": repeats.op11_runs,
    "op12_simhash": simhash.op12_simhash,
    "op13_negatives": negatives.op13_negatives,
}

SQL = {
    "op2_secrets": secrets.op2_sql,
    "op3_topk": lambda: topk.OP3_SQL,
    "op8_jaccard": lambda: jaccard.OP8_SQL,
    "op9_licences": licences.op9_sql,
    "op13_negatives": lambda: negatives.OP13_SQL,
}


def oracle_sql() -> dict[str, str]:
    return {name: make() for name, make in SQL.items()}
