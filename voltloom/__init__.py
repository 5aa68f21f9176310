"""Load-profile analytics on Spark: interval reshaping, profiles, clustering, tariffs, census features, quality."""
