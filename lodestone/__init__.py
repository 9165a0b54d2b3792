"""Evidence retrieval, graph exploration and evaluation over passage corpora on Spark."""
