"""The corpus queries and, where SQL can state them, their DuckDB SQL."""

from .op01_mixing import op1_mixing
from .op02_simhash import op2_simhash
from .op03_media import op3_media
from .op04_licenses import SQL as LICENSE_SQL
from .op04_licenses import op4_license_scan
from .op05_quality import SQL as QUALITY_SQL
from .op05_quality import op5_quality
from .op06_sentencepiece import op6_sentencepiece
from .op07_sharding import op7_sharding
from .op08_substring import op8_substring_dedup
from .op09_tokens import op9_token_counts
from .op10_scoring import op10_lm_scoring
from .op11_toxicity import op11_toxicity
from .op12_runs import op12_periodic_runs
from .op13_ranking import SQL as RANKING_SQL
from .op13_ranking import op13_ranked_search

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_media": op3_media,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_sharding": op7_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op4_license_scan": LICENSE_SQL,
    "op5_quality": QUALITY_SQL,
    "op13_ranked_search": RANKING_SQL,
}
