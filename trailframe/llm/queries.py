"""Queries of the operators on text, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailframe.llm.decontamination import op2_decontamination
from trailframe.llm.dual_tree import op11_dual_tree
from trailframe.llm.jaccard_join import op7_jaccard_join
from trailframe.llm.licences import op5_licences
from trailframe.llm.line_crf import op1_line_crf
from trailframe.llm.mixing import op10_mixing
from trailframe.llm.pitman_yor import op9_pitman_yor
from trailframe.llm.quality_knn import op6_quality_knn
from trailframe.llm.secrets import op4_secrets
from trailframe.llm.sorted_lists import op12_sorted_lists
from trailframe.llm.suffix_dedup import op3_suffix_dedup
from trailframe.llm.token_rollup import op8_token_rollup
from trailframe.llm.turn_repair import op13_turn_repair

_ALL = (
    op1_line_crf, op2_decontamination, op3_suffix_dedup, op4_secrets, op5_licences, op6_quality_knn, op7_jaccard_join, op8_token_rollup,
    op9_pitman_yor, op10_mixing, op11_dual_tree, op12_sorted_lists, op13_turn_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
