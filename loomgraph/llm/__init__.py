"""Training-data operators over ``documents`` and ``embeddings``.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
