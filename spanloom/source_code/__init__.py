"""From Python source text to tokens, blocks, class hierarchies and contexts.  Pure Python, applied in Arrow batches."""
