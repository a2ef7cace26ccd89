"""Training-data operators (documents, pages, embeddings); nothing else in relcast imports this."""
