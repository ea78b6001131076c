"""End-to-end jobs composed from the operators: audit, report validation, repair texts, setup checks."""
