"""Fair-lending analytics as Spark DataFrame operators."""
