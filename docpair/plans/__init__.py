"""docpair.plans"""
