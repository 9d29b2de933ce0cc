"""Queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from markgrid.llm.embeddings import op2_projection_forest
from markgrid.llm.language import op10_output_codes
from markgrid.llm.mixing import op7_pfair_mixing
from markgrid.llm.packing import op8_best_fit_packing
from markgrid.llm.pieces import op11_piece_codec
from markgrid.llm.quality import op1_isolation_forest
from markgrid.llm.repair import OP12_SQL, op12_structure_repair
from markgrid.llm.repeats import op5_prefix_intervals
from markgrid.llm.secrets import op3_secret_scan
from markgrid.llm.simhash import op9_simhash_near_dedup
from markgrid.llm.toxicity import op4_toxic_segments
from markgrid.llm.trie import OP13_SQL, op13_prefix_trie
from markgrid.llm.urls import OP6_SQL, op6_digest_filter

QUERIES = {f.__name__: f for f in (op1_isolation_forest, op2_projection_forest, op3_secret_scan, op4_toxic_segments, op5_prefix_intervals, op6_digest_filter, op7_pfair_mixing, op8_best_fit_packing, op9_simhash_near_dedup, op10_output_codes, op11_piece_codec, op12_structure_repair, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {"op6_digest_filter": OP6_SQL, "op12_structure_repair": OP12_SQL, "op13_prefix_trie": OP13_SQL}
