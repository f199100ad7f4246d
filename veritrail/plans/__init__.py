"""Registered queries: each is a thin plan over the operators, with its check in plain SQL."""
