"""Parsers that run inside tasks: a source text in, imports and symbols out."""
