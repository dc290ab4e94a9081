"""Change tracking, batch and streaming."""
