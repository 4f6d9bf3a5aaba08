"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from cadenza.llm.chat import OP5_SQL, op5_chat_format
from cadenza.llm.collocations import OP11_SQL, op11_collocations
from cadenza.llm.langid import op9_language_id
from cadenza.llm.licenses import op10_licenses
from cadenza.llm.lm_scores import op13_lm_scores
from cadenza.llm.mixing import op3_mixing
from cadenza.llm.mtree import OP7_SQL, op7_top_k
from cadenza.llm.ngram_join import op2_ngram_jaccard
from cadenza.llm.pieces import op6_pieces
from cadenza.llm.pii import op1_pii
from cadenza.llm.resample import OP12_SQL, op12_importance_resampling
from cadenza.llm.token_files import op4_token_files
from cadenza.llm.winnowing import op8_winnowing

QUERIES = {
    "op1_pii": op1_pii,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_mixing": op3_mixing,
    "op4_token_files": op4_token_files,
    "op5_chat_format": op5_chat_format,
    "op6_pieces": op6_pieces,
    "op7_top_k": op7_top_k,
    "op8_winnowing": op8_winnowing,
    "op9_language_id": op9_language_id,
    "op10_licenses": op10_licenses,
    "op11_collocations": op11_collocations,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_lm_scores": op13_lm_scores,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": OP5_SQL,
    "op7_top_k": OP7_SQL,
    "op11_collocations": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
