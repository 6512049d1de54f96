"""larkspan: table-in/table-out analytics operators for PySpark."""
