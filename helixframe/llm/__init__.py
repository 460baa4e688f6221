"""Operators for preparing training text: ten DataFrame operators and their queries."""
