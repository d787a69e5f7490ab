"""Operators on corpora: splitting, storing, verifying, ordering, packing, batching and what trainers count."""
