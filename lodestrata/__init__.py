"""lodestrata: document retrieval, planning and evaluation as Spark DataFrame operators."""
