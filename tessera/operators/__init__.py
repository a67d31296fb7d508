"""Relational operators over DataFrames. Each states a plan; Catalyst and AQE choose how it runs."""

from .aggregation import global_aggregate, group_by
from .cache import cached, on_disk
from .joins import block_nested_loop_join, cross_join, equi_join, grid_join, hash_join, index_lookup_join, natural_join, sort_merge_join, theta_join
from .relational import derived, limit, order_by, project, select, table_star, top_k
from .sets import union_all, union_distinct

__all__ = [
    "block_nested_loop_join", "cached", "cross_join", "derived", "equi_join", "global_aggregate", "grid_join", "group_by", "hash_join", "index_lookup_join", "limit",
    "natural_join", "on_disk", "order_by", "project", "select", "sort_merge_join", "table_star", "theta_join", "top_k", "union_all", "union_distinct",
]
