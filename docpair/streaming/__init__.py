"""docpair.streaming"""
