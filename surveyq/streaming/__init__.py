"""Structured Streaming: resumable file processing and windowed event counts."""
