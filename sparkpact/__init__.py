"""Contract data engine on Spark: JSON Schema / OpenAPI contracts compiled to DataFrame plans."""
