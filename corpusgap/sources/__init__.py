"""Reading and writing corpora, score sheets and result tables."""
