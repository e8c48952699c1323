"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from quillon.llm.chat import OP5_SQL, op5_chat_formatting
from quillon.llm.decontaminate import op4_benchmark_decontamination
from quillon.llm.html import op8_html_extraction
from quillon.llm.neardup import op9_minhash_near_dedup
from quillon.llm.oracle import SQL as BY_DEFINITION
from quillon.llm.packing import op3_best_fit_packing
from quillon.llm.pii import op1_pii_pseudonyms
from quillon.llm.quality import op2_quality_rules
from quillon.llm.substrings import op10_substring_dedup
from quillon.llm.suffixes import op6_suffix_array_dedup
from quillon.llm.tokencount import op7_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms, op2_quality_rules, op3_best_fit_packing, op4_benchmark_decontamination, op5_chat_formatting, op6_suffix_array_dedup, op7_token_counts, op8_html_extraction,
        op9_minhash_near_dedup, op10_substring_dedup,
    )
}
SQL = {"op5_chat_formatting": OP5_SQL} | BY_DEFINITION
