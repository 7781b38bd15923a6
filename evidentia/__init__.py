"""Evidence, text and graph analytics as composable DataFrame operators on PySpark."""
