"""Training-data operators: dedup, filtering, classification, mixing and tokenising on Spark."""
