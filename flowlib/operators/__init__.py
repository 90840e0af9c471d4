"""DataFrame operators: cleaning, splits, quality, thresholds, latency, backlog, rules and summaries."""
