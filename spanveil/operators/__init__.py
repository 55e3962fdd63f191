"""Span operators: recognise, gate, resolve, map, rewrite, measure."""
