"""Table operators: alignment, numbering, vocabularies, batches, scoring, checkpoints and inference."""
