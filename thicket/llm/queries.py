"""Queries of the training-data operators, and reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thicket.llm import decontaminate, line_dedup, mixing
from thicket.llm.conversation_repair import op12_conversation_repair
from thicket.llm.html_extract import op1_html_extract
from thicket.llm.jaccard_join import op6_jaccard_join
from thicket.llm.lm_scoring import op7_lm_scoring
from thicket.llm.media import op10_media
from thicket.llm.quality import op4_quality
from thicket.llm.secret_scan import op3_secret_scan
from thicket.llm.token_files import op5_token_files
from thicket.llm.toxicity import op8_toxicity
from thicket.llm.whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_extract, decontaminate.op2_decontaminate, op3_secret_scan, op4_quality, op5_token_files, op6_jaccard_join, op7_lm_scoring, op8_toxicity, mixing.op9_mixing, op10_media, line_dedup.op11_line_dedup, op12_conversation_repair, op13_whitening)}
SQL: dict[str, str] = {"op2_decontaminate": decontaminate.SQL, "op9_mixing": mixing.SQL, "op11_line_dedup": line_dedup.SQL}
