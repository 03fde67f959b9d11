"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .avi import op3_avi
from .bpe import op7_bpe
from .chat_format import OP4_SQL, op4_chat_format
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .html_text import op6_html_text
from .lang_id import op2_lang_id
from .lm_score import op1_lm_score
from .packing import op9_packing
from .simhash import op8_simhash
from .suffix_dedup import op5_suffix_dedup


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (op1_lm_score, op2_lang_id, op3_avi, op4_chat_format, op5_suffix_dedup, op6_html_text, op7_bpe, op8_simhash, op9_packing, op10_exact_dedup)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql():
    return {"op4_chat_format": OP4_SQL, "op10_exact_dedup": OP10_SQL}
