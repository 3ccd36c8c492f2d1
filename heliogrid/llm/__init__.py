"""Training-data operators (text quality, de-duplication, secrets, tokens, packing).

Nothing outside this subpackage imports it; ``llm.queries`` registers its
queries when the subpackage is present.
"""
