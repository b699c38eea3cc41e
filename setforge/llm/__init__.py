"""Training-data operators: deduplication, scoring, extraction and tokenisation of document tables."""
