"""The corpus queries by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from folioforge.llm.common import Query
from folioforge.llm.queries_audit import OP13_SQL, op13_filter_audit
from folioforge.llm.queries_bpe import op9_byte_bpe
from folioforge.llm.queries_chat import OP1_SQL, op1_perspectives
from folioforge.llm.queries_html import op10_html_text
from folioforge.llm.queries_language import op12_word_languages
from folioforge.llm.queries_license import OP8_SQL, op8_license_scan
from folioforge.llm.queries_mixing import OP2_SQL, op2_source_mix
from folioforge.llm.queries_ngram import op7_ngram_join
from folioforge.llm.queries_quality import OP6_SQL, op6_quality_rules
from folioforge.llm.queries_spelling import OP11_SQL, op11_spelling_variants
from folioforge.llm.queries_suffix import op5_suffix_dedup
from folioforge.llm.queries_vectors import op3_nn_descent
from folioforge.llm.queries_warc import OP4_SQL, op4_warc_zip


def queries() -> dict[str, Query]:
    return {
        "op1_perspectives": op1_perspectives,
        "op2_source_mix": op2_source_mix,
        "op3_nn_descent": op3_nn_descent,
        "op4_warc_zip": op4_warc_zip,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_ngram_join": op7_ngram_join,
        "op8_license_scan": op8_license_scan,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_html_text": op10_html_text,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_word_languages": op12_word_languages,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_perspectives": OP1_SQL,
        "op2_source_mix": OP2_SQL,
        "op4_warc_zip": OP4_SQL,
        "op6_quality_rules": OP6_SQL,
        "op8_license_scan": OP8_SQL,
        "op11_spelling_variants": op11_spelling_variants,
        "op11_spelling_variants": OP11_SQL,
        "op13_filter_audit": OP13_SQL,
    }
