"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from markfield.llm.chat import OP2_SQL, op2_chat_formatting
from markfield.llm.licenses import OP7_SQL, op7_license_scan
from markfield.llm.line_dedup import OP1_SQL, op1_line_dedup
from markfield.llm.packing import op9_best_fit_packing
from markfield.llm.pieces import op3_sentencepiece
from markfield.llm.quality import OP4_SQL, op4_quality_rules
from markfield.llm.simhash import op6_simhash_near_dedup
from markfield.llm.suffix_dedup import op10_suffix_array_dedup
from markfield.llm.topk import OP8_SQL, op8_bit_sliced_topk
from markfield.llm.warc import OP5_SQL, op5_warc_fixity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_bit_sliced_topk": op8_bit_sliced_topk,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}
SQL = {
    "op1_line_dedup": OP1_SQL,
    "op2_chat_formatting": OP2_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_warc_fixity": OP5_SQL,
    "op7_license_scan": OP7_SQL,
    "op8_bit_sliced_topk": OP8_SQL,
}
