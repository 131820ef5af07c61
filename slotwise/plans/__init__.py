"""Named compositions of operators, from source tables to evaluated predictions."""
