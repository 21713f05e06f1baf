"""docfathom: document-intelligence operators as composable Spark DataFrame plans."""
