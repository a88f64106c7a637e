"""Analytics over file-metadata catalogues on PySpark."""
