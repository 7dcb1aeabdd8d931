"""Structured Streaming: sinks, relays, fan-out and stateful release."""
