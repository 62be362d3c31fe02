"""Batch operators: DataFrames in, DataFrames out, nothing run until an action unless said."""
