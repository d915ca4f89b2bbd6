"""corrgrid: image-correspondence analytics and corpus operators on Spark."""
