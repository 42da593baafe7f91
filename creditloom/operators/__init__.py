"""DataFrame -> DataFrame operators over the loan tables."""
