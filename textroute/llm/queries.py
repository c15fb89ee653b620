"""All queries of this subpackage."""
import corpus_pipeline
from textroute.llm import (  # noqa: F401
    chat_format,
    chunk_bpe,
    decontamination,
    language_id,
    license_scan,
    near_duplicates,
    suffix_tree,
    token_files,
    toxicity,
    turn_repair,
    url_filter,
    vector_codes,
    vector_tree,
)
from textroute.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
