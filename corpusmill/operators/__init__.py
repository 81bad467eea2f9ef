"""DataFrame operators: retrieval, corpus maintenance, cleaning, chunking, evaluation, sessions, plans."""
