"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from foliant.llm.edit_fingerprint import op6_edit_fingerprint
from foliant.llm.fill_middle import OP12_SQL, op12_fill_middle
from foliant.llm.importance import op10_importance
from foliant.llm.license_scan import op2_license_scan
from foliant.llm.minhash import op5_minhash
from foliant.llm.packing import op9_packing
from foliant.llm.piece_transducer import op3_piece_transducer
from foliant.llm.sharding import op4_sharding
from foliant.llm.suffix_dedup import op8_suffix_dedup
from foliant.llm.token_alignment import op11_token_alignment
from foliant.llm.transport_stream import op1_transport_stream
from foliant.llm.url_reputation import op7_sql, op7_url_reputation
from foliant.llm.vantage_points import op13_vantage_points

QUERIES = {
    f.__name__: f
    for f in (
        op1_transport_stream,
        op2_license_scan,
        op3_piece_transducer,
        op4_sharding,
        op5_minhash,
        op6_edit_fingerprint,
        op7_url_reputation,
        op8_suffix_dedup,
        op9_packing,
        op10_importance,
        op11_token_alignment,
        op12_fill_middle,
        op13_vantage_points,
    )
}
SQL = {"op7_url_reputation": op7_sql(), "op12_fill_middle": OP12_SQL}
