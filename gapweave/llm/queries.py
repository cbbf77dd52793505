"""The queries of this package, and SQL for those that it can express."""
from __future__ import annotations

from . import bpe, jaccard, langid, mixing, ngram_lm, pii, syncmers, token_counts, topk, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity,
        bpe.op2_bpe,
        ngram_lm.op3_ngram_lm,
        token_counts.op4_token_counts,
        topk.op5_topk,
        langid.op6_language_id,
        pii.op7_pii,
        jaccard.op8_ngram_jaccard,
        mixing.op9_mixing,
        syncmers.op10_syncmers,
    )
}
ORACLES = {"op3_ngram_lm": ngram_lm.ORACLE, "op5_topk": topk.ORACLE}
