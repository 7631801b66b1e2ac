"""Training-data operators: one module per operator, plus ``queries`` which registers them.

Nothing outside this folder imports it, so the rest of the library works without it.
"""
