"""Training-data operators. Nothing outside this folder, the entry module and ``corpus_pipeline`` uses them."""
