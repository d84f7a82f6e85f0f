"""The queries of this package by name, with SQL where SQL can express them."""

from __future__ import annotations

from .bwt_dedup import op2_bwt_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .multi_index import op8_multi_index
from .near_dup import op9_circulant_minhash
from .oracles import OP1_SQL, OP7_SQL, OP9_SQL
from .packing import op10_pack_powers_of_two
from .periodic_runs import op13_periodic_runs
from .piece_bpe import op4_piece_encoding
from .ppm import op11_ppm_scores
from .quality_rules import op1_quality_rules
from .resampling import op3_importance_resampling
from .secret_scan import op7_secret_scan
from .sharding import op5_shuffle_shards
from .token_rollup import op6_token_rollup


def queries():
    """Each takes (spark, sf_dir) and gives its operator's rows over the whole table."""
    return {
        f.__name__: f
        for f in (
            op1_quality_rules, op2_bwt_dedup, op3_importance_resampling, op4_piece_encoding, op5_shuffle_shards,
            op6_token_rollup, op7_secret_scan, op8_multi_index, op9_circulant_minhash, op10_pack_powers_of_two,
            op11_ppm_scores, op12_filter_audit, op13_periodic_runs,
        )
    }


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB that gives the same rows."""
    return {"op1_quality_rules": OP1_SQL, "op7_secret_scan": OP7_SQL, "op9_circulant_minhash": OP9_SQL, "op12_filter_audit": OP12_SQL}
