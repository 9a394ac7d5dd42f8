"""All registered queries in one place."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.operators.trees import TAG_GROUPS
from pairlake.plans import flagship as flagship_plan
from pairlake.plans import editing, learning, measuring, modelling, pairing, perturbing, storing, texts

MODULES = (flagship_plan, pairing, texts, perturbing, measuring, editing, learning, modelling, storing)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in m.ORACLES.items()}
flagship = flagship_plan.flagship

# Counts that the check SQL gives in 64 bits.
AS_LONG = {
    **{name: ("rep",) for name in ("pairs_positive", "pairs_negative", "pairs_replicated", "record_json_back", "materialise")},
    **{name: ("n_tokens",) for name in ("lex_class", "lex_value", "stream_derive")},
    "token_distance": ("seed_length", "dest_length"),
    "first_success": ("attempt",), "token_table": ("pos",), "line_counts": ("lines",), "char_lengths": ("chars",),
    "compact_text": ("saved_bytes",), "string_array": ("words",), "eligible_literals": ("pos",), "profile_cells": ("chars",),
    "html_nodes": ("node_id", "parent_id"), "json_node_count": ("n",), "feature_vector": ("lines", "paragraphs"),
    "category_vector": tuple(TAG_GROUPS), "encode": ("length", "real"), "batch": ("width",), "clone_search": ("place",),
}


def _with_longs(query, columns):
    def run(spark, folder):
        df = query(spark, folder)
        return df.withColumns({c: F.col(c).cast("bigint") for c in columns})

    return run


for _name, _columns in AS_LONG.items():
    QUERIES[_name] = _with_longs(QUERIES[_name], _columns)
