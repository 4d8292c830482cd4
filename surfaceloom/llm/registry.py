"""The queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from surfaceloom.llm.jaccard import op5_jaccard_join
from surfaceloom.llm.mixing import op10_mixing
from surfaceloom.llm.neardup import op6_embedding_neardup
from surfaceloom.llm.oracles import ORACLES
from surfaceloom.llm.packing import op1_packing
from surfaceloom.llm.secrets import op4_secret_scans
from surfaceloom.llm.sharding import op7_extendible_sharding
from surfaceloom.llm.spans import op8_sentence_spans
from surfaceloom.llm.substrings import op9_suffix_dedup
from surfaceloom.llm.topk import op2_exact_topk
from surfaceloom.llm.toxicity import op3_toxicity

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_exact_topk, op3_toxicity, op4_secret_scans, op5_jaccard_join, op6_embedding_neardup, op7_extendible_sharding, op8_sentence_spans, op9_suffix_dedup, op10_mixing)
}
