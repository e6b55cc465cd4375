"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .decontamination import OP9_SQL, op9_decontamination
from .fingerprints import op2_fingerprints
from .language_id import op10_language_id
from .license_scan import op6_license_scan
from .minhash_dedup import op4_minhash_dedup
from .periodic_runs import op13_periodic_runs
from .piece_encoding import op3_piece_encoding
from .quality_rules import op12_quality_rules
from .sharding import op5_sharding
from .source_audit import OP11_SQL, op11_source_audit
from .substring_dedup import op1_substring_dedup
from .token_counts import op7_token_counts
from .warc import op8_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_fingerprints,
        op3_piece_encoding,
        op4_minhash_dedup,
        op5_sharding,
        op6_license_scan,
        op7_token_counts,
        op8_warc,
        op9_decontamination,
        op10_language_id,
        op11_source_audit,
        op12_quality_rules,
        op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = {"op9_decontamination": OP9_SQL, "op11_source_audit": OP11_SQL}
