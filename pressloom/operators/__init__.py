"""pressloom.operators"""
