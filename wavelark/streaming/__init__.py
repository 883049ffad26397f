"""Streaming counterparts of framing, quantization and the forward pass."""
