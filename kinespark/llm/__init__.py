"""Training-data operators: each is a Spark job over whole tables, with its registered query beside it."""

from importlib import import_module

OPERATORS = ["ngram_join", "secret_scan", "exact_dedup", "mixing", "sharding", "packing", "language_id", "embedding_dedup", "warc", "lm_scoring",
             "piece_tokens", "hard_negatives", "merkle"]


def load_all() -> tuple[dict, dict]:
    """Queries and SQL of all operators."""
    for name in OPERATORS:
        import_module(f"{__name__}.{name}")
    from . import common
    return common.QUERIES, common.ORACLES
