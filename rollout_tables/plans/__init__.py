"""Registered queries, their SQL oracles, shared inputs and plan checks."""
