"""Queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from larder.llm import align_tokenizers, chat, collocations, decontaminate, html_extract, language_id, licenses, line_dedup, media, sentencepiece_codec, simhash, suffix_dedup, token_counts


def queries() -> dict:
    found = [
        sentencepiece_codec.op1_sentencepiece,
        html_extract.op2_html_extract,
        media.op3_media_columns,
        token_counts.op4_token_counts,
        suffix_dedup.op5_suffix_dedup,
        simhash.op6_simhash,
        line_dedup.op7_line_dedup,
        chat.op8_chat_format,
        language_id.op9_language_id,
        decontaminate.op10_decontaminate,
        align_tokenizers.op11_align_tokenizers,
        licenses.op12_license_scans,
        collocations.op13_collocations,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": line_dedup.OP7_SQL, "op8_chat_format": chat.OP8_SQL, "op10_decontaminate": decontaminate.OP10_SQL, "op12_license_scans": licenses.OP12_SQL, "op13_collocations": collocations.OP13_SQL}
