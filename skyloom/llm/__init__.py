"""Operators for preparing training text: one module per operator, nothing else imports this subpackage."""
