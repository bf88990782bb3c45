"""Document analytics and batch question answering as Spark DataFrame operators."""
