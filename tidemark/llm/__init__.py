"""Training-data operators over documents, vectors and conversations."""
