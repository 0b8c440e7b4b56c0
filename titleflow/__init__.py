"""titleflow: catalogues of titles and the audience reviews written about them, on Spark."""
