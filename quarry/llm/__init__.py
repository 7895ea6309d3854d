"""Operators that prepare source code and documents for training language models."""
