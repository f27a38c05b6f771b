"""churnlake: customer-retention analytics as Spark DataFrame operators."""
