"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bagminhash import op9_near_dedup
from .bpe import op3_bpe_round_trip
from .ego_join import OP4_SQL, op4_near_vectors
from .licences import OP7_SQL, op7_licence_scan
from .line_dedup import OP6_RUNS_SQL, OP6_SQL, op6_line_dedup, op6_line_runs
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import OP2_SQL, op2_mix_sources
from .quality import OP10_SQL, op10_quality_rules
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .suffix_dedup import OP8_SQL, op8_suffix_dedup
from .token_alignment import op11_token_alignment
from .token_files import op5_token_files
from .warc import OP12_SQL, op12_warc_index

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_mix_sources,
        op3_bpe_round_trip,
        op4_near_vectors,
        op5_token_files,
        op6_line_dedup,
        op7_licence_scan,
        op8_suffix_dedup,
        op9_near_dedup,
        op10_quality_rules,
        op11_token_alignment,
        op12_warc_index,
        op13_merkle_manifest,
    )
}

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op2_mix_sources": OP2_SQL,
    "op4_near_vectors": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_licence_scan": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
    "op12_warc_index": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}

#: Whole forms of operators above whose results their SQL fixes.
WHOLE = {"op6_line_runs": op6_line_runs}
WHOLE_SQL = {"op6_line_runs": OP6_RUNS_SQL}
