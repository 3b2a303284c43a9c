"""pressloom.plans"""
