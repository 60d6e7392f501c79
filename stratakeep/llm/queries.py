"""The operators' queries and their SQL, as the entry module registers them."""

from __future__ import annotations

from . import mixing, near_duplicates, substring_dedup, url_filter, warc
from .decontamination import op7_decontamination
from .language_model import op3_lm_scoring
from .mixing import op9_mix_sources
from .near_duplicates import op2_ngram_jaccard
from .quality import op10_quality_rules
from .sharding import op1_shard_ring
from .substring_dedup import op4_substring_dedup
from .token_counts import op8_token_counts
from .url_filter import op6_url_filter
from .warc import op5_warc

QUERIES = {
    "op1_shard_ring": op1_shard_ring,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": near_duplicates.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
}
