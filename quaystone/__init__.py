"""Panel analytics on PySpark: DataFrame-to-DataFrame operators over (symbol, date) series."""
