"""Operators for text that is to train language models; nothing else imports this package."""
