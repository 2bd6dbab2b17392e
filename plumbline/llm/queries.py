"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from plumbline.llm.extraction import op8_html_extraction
from plumbline.llm.fingerprints import op3_fingerprints
from plumbline.llm.langid import op10_language_id
from plumbline.llm.media import op2_media_columns
from plumbline.llm.mixing import OP1_SQL, op1_source_mix
from plumbline.llm.ngram_join import OP6_SQL, op6_ngram_jaccard
from plumbline.llm.sentencepieces import op7_sentencepiece
from plumbline.llm.toxicity import op9_toxicity
from plumbline.llm.url_lists import OP5_SQL, op5_url_lists
from plumbline.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_media_columns": op2_media_columns,
    "op3_fingerprints": op3_fingerprints,
    "op4_warc": op4_warc,
    "op5_url_lists": op5_url_lists,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html_extraction": op8_html_extraction,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
}

ORACLES = {"op1_source_mix": OP1_SQL, "op4_warc": OP4_SQL, "op5_url_lists": OP5_SQL, "op6_ngram_jaccard": OP6_SQL}
