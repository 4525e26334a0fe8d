"""prismloom: hyperspectral feature extraction and corpus preparation as Spark jobs."""
