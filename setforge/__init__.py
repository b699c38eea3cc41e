"""setforge: curated file sets, profile analytics and training-data operators on Spark."""
