"""The queries of the llm operators and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from covey.llm import embedding_dedup, urlfilter
from covey.llm.ann import op7_ann
from covey.llm.embedding_dedup import op1_embedding_dedup
from covey.llm.html_extract import op4_html_extract
from covey.llm.minhash import op6_minhash
from covey.llm.mixing import op8_source_mixing
from covey.llm.sentencepiece_scan import op9_sentencepiece
from covey.llm.substring import op2_substring_dedup
from covey.llm.toxicity import op10_toxicity
from covey.llm.urlfilter import op5_url_filter
from covey.llm.warc import op3_warc

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_html_extract": op4_html_extract,
    "op5_url_filter": op5_url_filter,
    "op6_minhash": op6_minhash,
    "op7_ann": op7_ann,
    "op8_source_mixing": op8_source_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": embedding_dedup.ORACLE_SQL, "op5_url_filter": urlfilter.ORACLE_SQL}
