"""Frame analytics on Spark: catalog, pixel statistics, stars, series and image-plane transforms."""
