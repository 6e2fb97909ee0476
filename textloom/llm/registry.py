"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline

from .ann import op1_hnsw_shards
from .language import op7_evidence_fusion
from .mixing import op4_low_discrepancy_mix
from .packing import op9_minimum_bin_slack
from .quality import op5_covariance_outliers
from .secrets import OP6_SQL, op6_blob_ledger
from .sharding import op2_hilbert_shards
from .simhash import op8_simhash_pivots
from .toxicity import op3_lexicon_automata
from .warc import OP10_SQL, op10_sharded_warc

QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_hnsw_shards, op2_hilbert_shards, op3_lexicon_automata, op4_low_discrepancy_mix, op5_covariance_outliers, op6_blob_ledger, op7_evidence_fusion, op8_simhash_pivots, op9_minimum_bin_slack, op10_sharded_warc)}
ORACLES: dict[str, str] = {"op6_blob_ledger": OP6_SQL, "op10_sharded_warc": OP10_SQL}
