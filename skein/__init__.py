"""skein: text-stream trend analytics and data processing on Spark."""
