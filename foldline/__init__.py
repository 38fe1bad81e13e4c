"""foldline: sequence-profile analytics and training-data preparation on PySpark."""
