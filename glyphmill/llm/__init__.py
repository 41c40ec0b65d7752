"""Operators for training data: duplicates, survivorship, tokens, packing and language. Nothing else imports this."""
