"""Point-in-time peer analytics and corpus preparation as Spark DataFrame plans."""
