"""Functions that clients may know and that this engine refuses by name.

A name with one of these beginnings, or in the list, is answered with an error
that says so, rather than with a guess. Names that the function library has are
never refused.
"""

from __future__ import annotations

_BEGINNINGS = ("system$", "st_", "h3_", "bitmap_", "hll_", "minhash", "ai_", "dp_interval", "cortex_")
_NAMES = frozenset(
    """
    approximate_jaccard_index approximate_similarity approx_top_k build_scoped_file_url build_stage_file_url classify_text collate collation complete
    compress conditional_change_event count_tokens current_account current_available_roles current_organization_name current_region
    current_secondary_roles current_statement current_transaction decompress_binary decompress_string decrypt encrypt
    generator get_ddl get_presigned_url get_relative_path get_stage_location getvariable hash_agg infer_schema invoker_role
    invoker_share is_role_in_session normal seq1 seq2 seq4 seq8 object_schema ratio_to_report split_to_table strip_null_value strtok_split_to_table
    to_geography to_geometry to_query to_xml try_decrypt try_decrypt_raw uniform validate vector_cosine_similarity
    vector_inner_product vector_l1_distance vector_l2_distance xmlget zipf
    """.split()
)


def is_rejected(name: str) -> bool:
    return name in _NAMES or name.startswith(_BEGINNINGS)
