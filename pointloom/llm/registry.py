"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from . import collocations, decontaminate, fill_in_middle, inner_products, oracles
from .collocations import op12_phrase_collocations
from .decontaminate import op2_benchmark_decontamination
from .fill_in_middle import op13_fill_in_middle
from .fm_index import op4_substring_dedup
from .inner_products import op11_exact_top_k
from .licenses import op5_license_scans
from .line_dedup import op3_line_dedup
from .pieces import op7_sentencepiece
from .quality import op9_quality_rules
from .simhash import op1_simhash_near_dedup
from .suffix_family import op6_suffix_array_dedup
from .token_counts import op8_token_counts
from .tokens import op10_token_binary_output

_ALL = (op1_simhash_near_dedup, op2_benchmark_decontamination, op3_line_dedup, op4_substring_dedup, op5_license_scans, op6_suffix_array_dedup, op7_sentencepiece, op8_token_counts, op9_quality_rules, op10_token_binary_output, op11_exact_top_k, op12_phrase_collocations, op13_fill_in_middle)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op4_substring_dedup": oracles.OP4,
    "op6_suffix_array_dedup": oracles.OP6,
    "op9_quality_rules": oracles.OP9,
    "op11_exact_top_k": inner_products.ORACLE,
    "op12_phrase_collocations": collocations.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
