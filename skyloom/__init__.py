"""Spark-native map making: time-ordered samples to pixelised sky maps, as DataFrame plans."""
