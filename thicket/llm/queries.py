"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thicket.llm.ann import op6_ann
from thicket.llm.chat import op7_chat
from thicket.llm.decontaminate import ORACLE as DECONTAMINATE_SQL
from thicket.llm.decontaminate import op9_decontaminate
from thicket.llm.jaccard import ORACLE as JACCARD_SQL
from thicket.llm.jaccard import op8_jaccard
from thicket.llm.license_scan import op10_license
from thicket.llm.mix import op2_mix
from thicket.llm.oracles import CHATS, LICENSES, REPEATS, RESAMPLES, SHARDS, TOKENS
from thicket.llm.quality import op1_quality
from thicket.llm.resample import op12_resample
from thicket.llm.shard import op5_shard
from thicket.llm.suffix_dedup import op4_suffix_dedup
from thicket.llm.token_count import op3_tokens
from thicket.llm.token_files import op13_token_files
from thicket.llm.whitening import op11_whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_mix": op2_mix,
    "op3_tokens": op3_tokens,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_shard": op5_shard,
    "op6_ann": op6_ann,
    "op7_chat": op7_chat,
    "op8_jaccard": op8_jaccard,
    "op9_decontaminate": op9_decontaminate,
    "op10_license": op10_license,
    "op11_whiten": op11_whiten,
    "op12_resample": op12_resample,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op3_tokens": TOKENS,
    "op4_suffix_dedup": REPEATS,
    "op5_shard": SHARDS,
    "op7_chat": CHATS,
    "op8_jaccard": JACCARD_SQL,
    "op9_decontaminate": DECONTAMINATE_SQL,
    "op10_license": LICENSES,
    "op12_resample": RESAMPLES,
}
