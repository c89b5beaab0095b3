"""Registered queries, their oracles and the data they run over."""
