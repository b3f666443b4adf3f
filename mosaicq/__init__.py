"""mosaicq: spatial-omics table operators expressed as lazy Spark plans."""
