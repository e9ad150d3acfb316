"""Training-data operators: cleaning, deduplication, mixing and packaging of corpora."""
