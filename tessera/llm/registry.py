"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from . import decontamination, html_text, jaccard_join, language_id, packing, quality, sharding, token_counts, url_filter, wavelet

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_language_id": language_id.op4_language_id,
    "op5_sharding": sharding.op5_sharding,
    "op6_html_text": html_text.op6_html_text,
    "op7_quality": quality.op7_quality,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_packing": packing.op9_packing,
    "op10_token_files": wavelet.op10_token_files,
}

ORACLES = {
    "op1_jaccard_join": jaccard_join.OP1_SQL,
    "op2_decontamination": decontamination.OP2_SQL,
    "op4_language_id": language_id.OP4_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
}
