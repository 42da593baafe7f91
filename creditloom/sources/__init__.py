"""Reading and writing: loan tables, CSV, metric tables, fitted models."""
