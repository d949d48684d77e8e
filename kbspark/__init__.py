"""Knowledge-corpus analytics as Spark jobs: plain functions from DataFrame to DataFrame."""
