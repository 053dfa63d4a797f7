"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from verdure.llm import divergence, html, langid, lines, mixing, near, ogg, pieces, quality, resample, tokens, topk, urls

QUERIES = {
    f.__name__: f
    for f in (
        pieces.op1_sentencepiece,
        html.op2_html,
        tokens.op3_token_counts,
        mixing.op4_mixing,
        quality.op5_quality,
        topk.op6_topk,
        lines.op7_line_dedup,
        ogg.op8_ogg,
        near.op9_near_dedup,
        langid.op10_language_id,
        urls.op11_url_filters,
        resample.op12_importance_resampling,
        divergence.op13_divergence,
    )
}
SQL = {"op4_mixing": mixing.OP4_SQL, "op6_topk": topk.OP6_SQL, "op11_url_filters": urls.OP11_SQL, "op12_importance_resampling": resample.OP12_SQL, "op13_divergence": divergence.OP13_SQL}
