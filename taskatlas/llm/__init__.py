"""Operators for preparing training data, and their queries; nothing else in the library imports this."""
