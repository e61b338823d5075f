"""siftlake: ranked file and content search as DataFrame plans."""
