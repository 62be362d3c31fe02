"""quarry: ranked text retrieval, activity-log analytics and data preparation on PySpark."""
