"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``registry`` lists its queries and
their SQL; each other module holds one operator with a general interface.
"""
