"""The registered queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from . import bpe, class_lm, decontaminate, html_text, langid, media, quality, secrets, simhash, spelling, topk, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_langid": langid.op1_langid,
        "op2_simhash": simhash.op2_simhash,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_quality": quality.op4_quality,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_html": html_text.op6_html,
        "op7_bpe": bpe.op7_bpe,
        "op8_media": media.op8_media,
        "op9_class_lm": class_lm.op9_class_lm,
        "op10_secrets": secrets.op10_secrets,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_topk": topk.op12_topk,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.OP3_SQL,
        "op5_decontaminate": decontaminate.OP5_SQL,
        "op10_secrets": secrets.OP10_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_topk": topk.OP12_SQL,
    }
