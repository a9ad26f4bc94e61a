"""Structure large collections of administrative and legal documents on Spark."""
