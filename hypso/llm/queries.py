"""The queries of this subpackage, one for each operator, and SQL for those that SQL can state."""

from __future__ import annotations

from . import mixing, quality
from .audio import op9_chroma_prints
from .langid import op5_kneser_ney
from .mixing import op2_curriculum_mixing
from .neardup import op1_order_minhash
from .pieces import op6_piece_tables
from .pii import op10_shape_field
from .quality import op8_robust_outliers
from .repeats import op4_sentence_spans, op7_line_winnowing
from .sharding import op3_feistel_sharding


def queries() -> dict:
    return {
        "op1_order_minhash": op1_order_minhash,
        "op2_curriculum_mixing": op2_curriculum_mixing,
        "op3_feistel_sharding": op3_feistel_sharding,
        "op4_sentence_spans": op4_sentence_spans,
        "op5_kneser_ney": op5_kneser_ney,
        "op6_piece_tables": op6_piece_tables,
        "op7_line_winnowing": op7_line_winnowing,
        "op8_robust_outliers": op8_robust_outliers,
        "op9_chroma_prints": op9_chroma_prints,
        "op10_shape_field": op10_shape_field,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_curriculum_mixing": mixing.oracle(),
        "op8_robust_outliers": quality.oracle(),
    }
