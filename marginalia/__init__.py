"""Document annotations as Spark tables: sections, summaries, passages, crops and digests."""
