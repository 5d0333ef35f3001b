"""Operators for preparing training text: archives, licences, copies, quality, leaks, privacy, secrets, toxicity, tokens."""
