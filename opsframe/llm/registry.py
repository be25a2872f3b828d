"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from opsframe.llm.decontaminate import op10_decontaminate
from opsframe.llm.divergence import ORACLE as DIVERGENCE_ORACLE
from opsframe.llm.divergence import op13_source_divergence
from opsframe.llm.embedding_join import ORACLE as EMBEDDING_ORACLE
from opsframe.llm.embedding_join import op2_embedding_near_dedup
from opsframe.llm.license_scan import ORACLE as LICENSE_ORACLE
from opsframe.llm.license_scan import op6_license_scan
from opsframe.llm.mixing import op3_mixing
from opsframe.llm.page_text import op5_page_text
from opsframe.llm.simhash import op8_simhash
from opsframe.llm.spelling import op12_spelling_variants
from opsframe.llm.suffix_dedup import op7_suffix_dedup
from opsframe.llm.token_count import op4_token_counts
from opsframe.llm.top_k import ORACLE as TOP_K_ORACLE
from opsframe.llm.top_k import op11_exact_top_k
from opsframe.llm.toxicity import op1_toxicity
from opsframe.llm.url_filter import ORACLE as URL_ORACLE
from opsframe.llm.url_filter import op9_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_page_text": op5_page_text,
    "op6_license_scan": op6_license_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash": op8_simhash,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE = {
    "op2_embedding_near_dedup": EMBEDDING_ORACLE,
    "op6_license_scan": LICENSE_ORACLE,
    "op9_url_filter": URL_ORACLE,
    "op11_exact_top_k": TOP_K_ORACLE,
    "op13_source_divergence": DIVERGENCE_ORACLE,
}
