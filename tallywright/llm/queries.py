"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm.alignment import op11_tokenizer_alignment
from tallywright.llm.decontaminate import op3_decontamination
from tallywright.llm.divergence import OP13_SQL, op13_source_divergence
from tallywright.llm.exact_dedup import OP12_SQL, op12_exact_dedup
from tallywright.llm.language_id import op9_language_id
from tallywright.llm.line_dedup import OP10_SQL, op10_line_dedup
from tallywright.llm.ngram_join import op7_ngram_join
from tallywright.llm.packing import op4_token_packing
from tallywright.llm.pii import op5_pii
from tallywright.llm.quality import op8_quality
from tallywright.llm.sentencepiece_scan import op1_sentencepiece
from tallywright.llm.topk import OP2_SQL, op2_exact_topk
from tallywright.llm.url_filter import op6_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_topk": op2_exact_topk,
    "op3_decontamination": op3_decontamination,
    "op4_token_packing": op4_token_packing,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op2_exact_topk": OP2_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
