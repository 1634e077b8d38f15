"""The queries of this subpackage: name -> callable(spark, sf_dir), and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.brown_lm import op1_brown_lm
from tidemark.llm.html_blocks import op3_html_blocks
from tidemark.llm.line_frequency import OP5_SQL, op5_line_frequency
from tidemark.llm.mixture_packing import op6_mixture_packing
from tidemark.llm.quality_divergence import op10_quality_divergence
from tidemark.llm.setsketch import OP9_SQL, op9_setsketch
from tidemark.llm.spaced_seeds import op8_spaced_seeds
from tidemark.llm.substring_words import OP2_SQL, op2_substring_words
from tidemark.llm.suffix_dedup import op7_suffix_dedup
from tidemark.llm.toxicity_lexicon import op4_toxicity_lexicon

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_lm": op1_brown_lm,
    "op9_setsketch": op9_setsketch,
    "op10_quality_divergence": op10_quality_divergence,
    "op2_substring_words": op2_substring_words,
    "op5_line_frequency": op5_line_frequency,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op6_mixture_packing": op6_mixture_packing,
    "op3_html_blocks": op3_html_blocks,
    "op4_toxicity_lexicon": op4_toxicity_lexicon,
}

ORACLE: dict[str, str] = {
    "op2_substring_words": OP2_SQL,
    "op5_line_frequency": OP5_SQL,
    "op9_setsketch": OP9_SQL,
}
