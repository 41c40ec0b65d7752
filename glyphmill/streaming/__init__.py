"""State machines over event time, in batch and in Structured Streaming."""
