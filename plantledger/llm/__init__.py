"""Operators for preparing training text, and the queries that run them. Nothing else imports this package."""
