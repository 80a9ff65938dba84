"""docpair.functions"""
