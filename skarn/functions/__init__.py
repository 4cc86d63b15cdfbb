"""Functions of the retrieval and corpus analytics engine."""
