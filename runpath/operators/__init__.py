"""Operators over generic relations: symbols, edges, lines, constraints, events."""
