"""Low-rank matrix factorization and matrix completion as Spark DataFrame plans."""
