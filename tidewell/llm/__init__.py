"""Operators for training data; nothing else in the library imports this subpackage."""

from tidewell.llm import consensus_queries, crosssplit_queries, group_queries, mix_queries, page_queries, pair_queries, truncation_queries

MODULES = [consensus_queries, page_queries, pair_queries, group_queries, crosssplit_queries, mix_queries, truncation_queries]
