"""Training-data operators: chat formatting, token counts, dedup, search, mixing, language ID.

Each module holds one operator with its own general interface; ``queries`` registers the
``opN_<name>`` queries over the given tables. Nothing else in the package imports this one.
"""
