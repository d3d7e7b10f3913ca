"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .centroids import op11_centroid_clustering
from .embedding_duplicates import op3_embedding_near_dedup
from .html_text import op5_html_extraction
from .language_model import op2_lm_scoring
from .mixing import op4_mixing
from .near_duplicates import op6_ngram_jaccard_join
from .neighbours import op1_nearest_neighbours
from .oracles import ORACLE_SQL
from .packing import op9_packing
from .periodic_runs import op12_periodic_runs
from .personal_data import op13_personal_data
from .sharding import op10_sharding
from .toxicity import op8_toxicity
from .url_filter import op7_url_filter

QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_html_extraction": op5_html_extraction,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_personal_data": op13_personal_data,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
