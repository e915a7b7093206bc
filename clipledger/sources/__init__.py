"""Readers. Each returns a lazy DataFrame in a layout of clipledger.schemas."""
