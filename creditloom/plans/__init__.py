"""Named analyses composed from the operators, and the SQL catalogue."""
