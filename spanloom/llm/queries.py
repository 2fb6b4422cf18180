"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op3_byte_bpe
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .langid import op10_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .media_tiff import op4_tiff_media
from .packing import op7_best_fit_packing
from .paragraph_dedup import op6_paragraph_minhash
from .simhash import op5_simhash
from .suffix_dedup import op2_suffix_array_dedup
from .url_filter import op8_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_suffix_array_dedup, op3_byte_bpe, op4_tiff_media, op5_simhash,
        op6_paragraph_minhash, op7_best_fit_packing, op8_url_filter, op9_line_dedup, op10_language_id,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op9_line_dedup": OP9_SQL}
