"""Operators over the long frame of samples: DataFrame in, DataFrame out."""
