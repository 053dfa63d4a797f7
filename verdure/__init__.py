"""Field analytics on Spark: pixels to zonal statistics, and the queries above them."""
