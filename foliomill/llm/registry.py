"""Queries and oracle SQL of the training-data operators."""

from . import ann_partitions, chosen_paths, importance, language_id, ngram_join, packing, periodic_runs, quality_cnn, quality_rules, secret_scan, sentence_pieces, suffix_dedup, toxicity

MODULES = (suffix_dedup, ngram_join, toxicity, quality_rules, secret_scan, packing, quality_cnn, ann_partitions, sentence_pieces, language_id, importance, chosen_paths, periodic_runs)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
