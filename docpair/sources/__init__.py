"""docpair.sources"""
