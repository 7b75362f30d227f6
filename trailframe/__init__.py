"""trailframe: detection and classification results as DataFrames."""
