"""DataFrame operators for corpora of time-coded text and clip metadata."""
