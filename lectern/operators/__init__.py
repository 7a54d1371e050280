"""Operators: DataFrame in, DataFrame out, keyed by ``book_id``, order carried by explicit ordinals."""
