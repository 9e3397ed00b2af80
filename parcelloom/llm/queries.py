"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from parcelloom.llm.decontamination import OP3_SQL, op3_benchmark_decontamination
from parcelloom.llm.licenses import OP10_SQL, op10_license_scan
from parcelloom.llm.mixing import op9_pivotal_mixing
from parcelloom.llm.ngram_join import OP1_SQL, op1_ngram_jaccard_join
from parcelloom.llm.quality_classifier import op6_pu_quality_classifier
from parcelloom.llm.quality_rules import OP2_SQL, op2_quality_rules
from parcelloom.llm.sharding import op4_hypergeometric_sharding
from parcelloom.llm.substring_dedup import OP7_SQL, op7_fixed_block_dedup
from parcelloom.llm.token_output import op5_rans_token_output
from parcelloom.llm.warc import OP8_SQL, op8_chunked_warc

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_rules, op3_benchmark_decontamination, op4_hypergeometric_sharding, op5_rans_token_output, op6_pu_quality_classifier, op7_fixed_block_dedup, op8_chunked_warc, op9_pivotal_mixing, op10_license_scan)}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op2_quality_rules": OP2_SQL, "op3_benchmark_decontamination": OP3_SQL, "op7_fixed_block_dedup": OP7_SQL, "op8_chunked_warc": OP8_SQL, "op10_license_scan": OP10_SQL}
