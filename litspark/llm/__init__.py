"""Training-data operators; nothing outside this package and ``corpus_pipeline.py`` imports them."""
