"""The operators on streams: same results as in batch once the watermark has passed."""
