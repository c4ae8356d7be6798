"""Text encoding on Spark: cleaning, splitting, subword segmentation, encoding and decoding over DataFrames."""
