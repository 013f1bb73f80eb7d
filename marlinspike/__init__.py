"""marlinspike: note-memory analytics and data preparation on PySpark DataFrames."""
