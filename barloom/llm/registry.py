"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .divergence import OP11_SQL, op11_source_divergence
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .language_id import op1_language_id
from .line_dedup import OP4_SQL, op4_line_dedup
from .mixing import op5_mixing
from .nearest import OP7_SQL, op7_nearest
from .packing import op6_packing
from .partenum import OP13_SQL, op13_jaccard_join
from .periodic import op12_periodic_runs
from .secret_scan import op8_secret_scan
from .sharding import op3_sharding
from .simhash import op2_simhash
from .toxicity import op10_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_nearest": op7_nearest,
    "op8_secret_scan": op8_secret_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_jaccard_join": op13_jaccard_join,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op7_nearest": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_jaccard_join": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
