"""Batch and streaming retrieval, answering and guardrail analytics as DataFrame transforms."""
