"""docpair.operators"""
