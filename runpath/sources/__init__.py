"""Readers: source trees, the C front end, knowledge tables, scenarios."""
