"""Bundled grammars, the predictive-table builder and the lexers for problem 6."""
