"""Code-corpus analytics on Spark: files, symbols, imports and what can be derived from them."""
