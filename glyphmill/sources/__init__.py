"""Files in and out: corpora, dictionaries, signature datasets."""
