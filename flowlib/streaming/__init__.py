"""Structured Streaming: source, scoring plan, sinks, bounded runs, progress and the streaming label join."""
