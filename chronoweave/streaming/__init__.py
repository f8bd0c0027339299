"""Structured Streaming: rounds of change events, duplicate windows, and the state machine as a stateful operator."""
