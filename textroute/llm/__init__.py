"""Operators that prepare text for language models. Nothing outside this folder imports it."""
