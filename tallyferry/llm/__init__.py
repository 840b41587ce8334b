"""Training-data operators over text corpora, one module each, and the queries that apply them."""
