"""Operators on training text: one module per problem, queries in ``queries``."""
