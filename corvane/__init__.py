"""corvane: retrieval, evaluation and corpus curation as Spark DataFrame operators."""
