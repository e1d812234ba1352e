"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from .byte_bpe import op8_byte_bpe
from .centroid_clustering import OP13_SQL, op13_centroid_clustering
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_id import op7_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .ngram_join import op4_ngram_jaccard
from .packing import op6_best_fit_packing
from .pii import OP12_SQL, op12_pii
from .secret_scan import op1_secret_scan
from .suffix_dedup import op10_suffix_dedup
from .topk_search import OP2_SQL, op2_topk_search
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_topk_search": op2_topk_search,
    "op3_warc": op3_warc,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_pii": op12_pii,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL = {"op2_topk_search": OP2_SQL, "op3_warc": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op9_line_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_pii": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
